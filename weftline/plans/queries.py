"""Registered queries over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles, kernels
from ..operators import curves, fitting, group_fits, images, lines, linking, optimiser, orientation, reconstruction, spatial, thresholds, tracing, widths
from ..operators.storage import saver
from ..operators.threshold_grid import threshold_grid
from ..sources.made import CURVES_SQL, PIXELS_SQL, curve_points, pixels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; -0 becomes 0."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


PI = repr(math.pi)
HALF = repr(math.pi / 2)


def wrap_sql(a: str) -> str:
    m = f"(({a}) + {HALF}::DOUBLE - floor((({a}) + {HALF}::DOUBLE) / {PI}::DOUBLE) * {PI}::DOUBLE)"
    return f"(CASE WHEN {m} < 0 OR {m} >= {PI}::DOUBLE THEN 0.0::DOUBLE ELSE {m} END - {HALF}::DOUBLE)"


def kernel_values(order: int, sigma: float) -> str:
    mask = kernels.gauss_mask(order, sigma)
    n = len(mask) // 2
    return ", ".join(f"({j - n}, {m!r}::DOUBLE)" for j, m in enumerate(mask))


def beside_sql(table: str) -> str:
    """Rows of a table with cells cx, cy, once for each of the nine cells around them (nx, ny)."""
    return f"(SELECT t.*, cx + dx AS nx, cy + dy AS ny FROM {table} t CROSS JOIN (VALUES (-1), (0), (1)) gx(dx) CROSS JOIN (VALUES (-1), (0), (1)) gy(dy))"


def cells_sql(size: int) -> str:
    return f"CAST(floor(x / {size}) AS BIGINT) AS cx, CAST(floor(y / {size}) AS BIGINT) AS cy"


def mirrored(at: str, size: str) -> str:
    return f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} >= {size} THEN 2 * ({size} - 1) - ({at}) ELSE {at} END"


def _derivatives_sql(sigma: float = images.SIGMA) -> str:
    """CTEs up to `deriv`: frame, y, x, r, c, rr, rc, cc."""
    masks = ", ".join(f"k{k}(j, m) AS (VALUES {kernel_values(k, sigma)})" for k in range(3))
    down = ", ".join(
        f"x{k} AS MATERIALIZED (SELECT o.frame, o.y, o.x, k.m, {mirrored('o.y + k.j', 'o.h')} AS yy FROM sized o CROSS JOIN k{k} k), d{k} AS MATERIALIZED (SELECT o.frame, o.y, o.x, sum(p.v * o.m) AS s FROM x{k} o JOIN pixels p ON p.frame = o.frame AND p.x = o.x AND p.y = o.yy GROUP BY ALL)" for k in range(3)
    )
    across = ", ".join(f"z{k} AS MATERIALIZED (SELECT o.frame, o.y, o.x, k.m, {mirrored('o.x + k.j', 'o.w')} AS xx FROM sized o CROSS JOIN k{k} k)" for k in range(3))
    along = lambda name, d, k: f"{name} AS MATERIALIZED (SELECT o.frame, o.y, o.x, sum(p.s * o.m) AS {name} FROM z{k} o JOIN d{d} p ON p.frame = o.frame AND p.y = o.y AND p.x = o.xx GROUP BY ALL)"
    parts = ", ".join(along(n, d, k) for n, d, k in (("r", 1, 0), ("c", 0, 1), ("rr", 2, 0), ("rc", 1, 1), ("cc", 0, 2)))
    return f"""{PIXELS_SQL}, sized AS (SELECT *, max(y) OVER (PARTITION BY frame) + 1 AS h, max(x) OVER (PARTITION BY frame) + 1 AS w FROM pixels),
        {masks}, {down}, {across}, {parts},
        deriv AS (SELECT frame, y, x, r, c, rr, rc, cc FROM r JOIN c USING (frame, y, x) JOIN rr USING (frame, y, x) JOIN rc USING (frame, y, x) JOIN cc USING (frame, y, x))"""


DERIVATIVES = _derivatives_sql()

RIDGES = f"""{DERIVATIVES},
    e1 AS (SELECT *, (rr + cc) / 2 AS mean, sqrt((rr - cc) / 2 * ((rr - cc) / 2) + rc * rc) AS root, sqrt(r * r + c * c) AS gradient FROM deriv),
    e2 AS (SELECT *, CASE WHEN mean > 0 THEN mean + root ELSE mean - root END AS l FROM e1),
    e3 AS (SELECT *, CASE WHEN abs(l - rr) > abs(l - cc) THEN rc ELSE l - cc END AS u, CASE WHEN abs(l - rr) > abs(l - cc) THEN l - rr ELSE rc END AS v FROM e2),
    e4 AS (SELECT *, (CASE WHEN v < 0 OR (v = 0 AND u < 0) THEN -1 ELSE 1 END) / sqrt(u * u + v * v) AS k FROM e3),
    e5 AS (SELECT *, k * u AS ny, k * v AS nx, -l AS response FROM e4),
    e6 AS (SELECT *, -(r * ny + c * nx) / nullif(rr * ny * ny + 2 * rc * ny * nx + cc * nx * nx, 0) AS t FROM e5),
    ridges AS (SELECT frame, y, x, response, ny, nx, y + t * ny AS py, x + t * nx AS px, gradient,
               coalesce(abs(t * ny) <= {images.BOUNDARY} AND abs(t * nx) <= {images.BOUNDARY}, false) AS near FROM e6)"""


@query(f"WITH {DERIVATIVES} SELECT frame, y, x, round(r, 6) + 0 AS r, round(c, 6) + 0 AS c, round(rr, 6) + 0 AS rr, round(rc, 6) + 0 AS rc, round(cc, 6) + 0 AS cc FROM deriv")
def gauss_derivatives(spark, sf_dir):
    return rounded(images.gauss_derivatives(pixels(spark, sf_dir)), "r", "c", "rr", "rc", "cc")


def _ridges(spark, sf_dir):
    return images.ridge_points(images.gauss_derivatives(pixels(spark, sf_dir)))


@query(f"WITH {RIDGES} SELECT frame, y, x, round(response, 5) + 0 AS response, round(gradient, 5) + 0 AS gradient, round(ny * ny, 4) + 0 AS ny2, near FROM ridges")
def ridge_points(spark, sf_dir):
    found = _ridges(spark, sf_dir).withColumns({"near": images.near_centre(), "ny2": F.col("ny") * F.col("ny")})
    return rounded(rounded(found, "response", "gradient", digits=5), "ny2", digits=4).select("frame", "y", "x", "response", "gradient", "ny2", "near")


@query(f"""WITH {RIDGES}, classed AS (SELECT frame, CASE WHEN NOT near THEN 0 WHEN response >= 0.5 THEN 2 WHEN response >= 0.25 THEN 1 ELSE 0 END AS line_class FROM ridges)
    SELECT frame, CAST(line_class AS INTEGER) AS line_class, count(*) AS n FROM classed GROUP BY ALL""")
def line_class_counts(spark, sf_dir):
    return images.classify(_ridges(spark, sf_dir), 0.25, 0.5).groupBy("frame", F.col("line_class").cast("int").alias("line_class")).agg(F.count("*").alias("n"))


@query(f"WITH {RIDGES} SELECT frame, y, x, round(CASE WHEN near AND response > 0 THEN response ELSE 0 END, 5) + 0 AS v FROM ridges")
def saliency(spark, sf_dir):
    return rounded(images.saliency(_ridges(spark, sf_dir)), "v", digits=5)


def _histogram_sql(bins: int) -> str:
    return f"""{PIXELS_SQL}, span AS (SELECT frame, min(v) AS least, max(v) AS most, (max(v) - min(v)) / {bins} AS width FROM pixels GROUP BY frame),
    hist AS MATERIALIZED (SELECT frame, least, width, CAST(CASE WHEN width = 0 THEN 0 ELSE least({bins - 1}, floor((v - least) / nullif(width, 0))) END AS INTEGER) AS bin, count(*) AS n FROM pixels JOIN span USING (frame) GROUP BY ALL)"""


HISTOGRAM = _histogram_sql(16)
FINE_HISTOGRAM = _histogram_sql(256)


@query(f"WITH {HISTOGRAM} SELECT frame, bin, n, least, width FROM hist")
def pixel_histogram(spark, sf_dir):
    return images.histogram(pixels(spark, sf_dir), 16)


@query(f"""WITH {HISTOGRAM},
    s AS (SELECT frame, bin, least, width, CAST(sum(n) OVER b AS DOUBLE) AS n1, CAST(sum(n * bin) OVER b AS DOUBLE) AS s1, CAST(sum(n) OVER (PARTITION BY frame) AS DOUBLE) AS n2, CAST(sum(n * bin) OVER (PARTITION BY frame) AS DOUBLE) AS s2
          FROM hist WINDOW b AS (PARTITION BY frame ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT *, coalesce((s1 * n2 - s2 * n1) * (s1 * n2 - s2 * n1) / nullif(n1 * (n2 - n1), 0), -1) AS gain FROM s),
    f AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY gain DESC, bin) AS place FROM g)
    SELECT frame, round(least + width * (bin + 1), 6) + 0 AS threshold FROM f WHERE place = 1""")
def otsu_threshold(spark, sf_dir):
    return rounded(images.otsu_threshold(pixels(spark, sf_dir), 16), "threshold")


_MEANS = """mn AS (SELECT *, s1 / n1 AS m0, (s2 - s1) / nullif(n2 - n1, 0) AS m1 FROM (SELECT *, CAST(sum(n) OVER b AS DOUBLE) AS n1, CAST(sum(n * bin) OVER b AS DOUBLE) AS s1, CAST(sum(n) OVER (PARTITION BY frame) AS DOUBLE) AS n2,
    CAST(sum(n * bin) OVER (PARTITION BY frame) AS DOUBLE) AS s2, lead(bin) OVER (PARTITION BY frame ORDER BY bin) AS nxt, CAST(max(bin) OVER (PARTITION BY frame) - min(bin) OVER (PARTITION BY frame) AS DOUBLE) AS sp FROM hh WINDOW b AS (PARTITION BY frame ORDER BY bin ROWS UNBOUNDED PRECEDING)))"""


@query(f"""WITH {FINE_HISTOGRAM}, hh AS (SELECT * FROM hist), {_MEANS},
    u AS (SELECT t.frame, t.least, t.width, t.bin, t.m1, h.n, 1 / (1 + abs(h.bin - CASE WHEN h.bin <= t.bin THEN t.m0 ELSE t.m1 END) / t.sp) AS u FROM mn t JOIN hist h USING (frame)),
    z AS (SELECT frame, least, width, bin, round(sum(CASE WHEN u > 1e-6 AND u < 1 - 1e-6 THEN n * (-u * ln(u) - (1 - u) * ln(1 - u)) ELSE 0 END), 9) AS fuzzy, bool_or(m1 IS NULL) AS none FROM u GROUP BY ALL)
    SELECT frame, round(least + width * (bin + 1), 6) + 0 AS threshold FROM z QUALIFY row_number() OVER (PARTITION BY frame ORDER BY none, fuzzy, bin) = 1""")
def huang_threshold(spark, sf_dir):
    return rounded(thresholds.huang_threshold(pixels(spark, sf_dir)), "threshold")


@query(f"""WITH {FINE_HISTOGRAM}, pl AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS second FROM hist WINDOW w AS (PARTITION BY frame ORDER BY n DESC, bin)),
    hh AS (SELECT frame, least, width, bin, CASE WHEN place = 1 AND n > 2 * second THEN CAST(floor(second * 1.5) AS BIGINT) ELSE n END AS n FROM pl), {_MEANS}
    SELECT frame, round(least + width * (CASE WHEN nxt > (m0 + m1) / 2 THEN floor((m0 + m1) / 2 + 0.5) ELSE bin END + 1), 6) + 0 AS threshold
    FROM mn QUALIFY row_number() OVER (PARTITION BY frame ORDER BY NOT coalesce(nxt > (m0 + m1) / 2, false), bin) = 1""")
def intermeans_threshold(spark, sf_dir):
    return rounded(thresholds.intermeans_threshold(pixels(spark, sf_dir)), "threshold")


@query(f"""WITH RECURSIVE {FINE_HISTOGRAM}, every AS (SELECT frame, least, width, b.bin, coalesce(h.n, 0) AS n FROM span CROSS JOIN (SELECT CAST(unnest(range(256)) AS INTEGER) AS bin) b LEFT JOIN hist h USING (frame, least, width, bin)),
    cs AS MATERIALIZED (SELECT frame, least, width, bin, CAST(sum(n) OVER w AS DOUBLE) AS n0, CAST(sum(n * bin) OVER w AS DOUBLE) AS s0, CAST(sum(n * bin * bin) OVER w AS DOUBLE) AS q0 FROM every WINDOW w AS (PARTITION BY frame ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    al AS MATERIALIZED (SELECT frame, least, width, n0 AS n, s0 AS s, q0 AS q FROM cs WHERE bin = 255),
    st AS MATERIALIZED (SELECT *, s0 / n0 AS m0, (s - s0) / nullif(n - n0, 0) AS m1 FROM cs JOIN al USING (frame, least, width) WHERE n0 > 0),
    vr AS MATERIALIZED (SELECT *, q0 / n0 - m0 * m0 AS v0, (q - q0) / nullif(n - n0, 0) - m1 * m1 AS v1, n0 / n AS pp, (n - n0) / n AS qq FROM st),
    ww AS MATERIALIZED (SELECT *, 1 / v0 - 1 / v1 AS w0, m0 / v0 - m1 / v1 AS w1, m0 * m0 / v0 - m1 * m1 / v1 + ln((v0 * qq * qq) / (v1 * pp * pp)) AS w2 FROM vr WHERE v0 > 0 AND v1 > 0),
    nx AS MATERIALIZED (SELECT frame, bin, floor((w1 + sqrt(w1 * w1 - w0 * w2)) / nullif(w0, 0)) AS new FROM ww WHERE w1 * w1 - w0 * w2 >= 0),
    go(frame, k, bin) AS (SELECT frame, 0, CAST(floor(s / n) AS INTEGER) FROM al UNION ALL
        SELECT g.frame, g.k + 1, CASE WHEN x.new >= 0 AND x.new < 256 THEN CAST(x.new AS INTEGER) ELSE g.bin END FROM go g LEFT JOIN nx x ON x.frame = g.frame AND x.bin = g.bin WHERE g.k < 64)
    SELECT frame, round(least + width * (go.bin + 1), 6) + 0 AS threshold FROM go JOIN al USING (frame) WHERE k = 64""")
def minimum_error_threshold(spark, sf_dir):
    return rounded(thresholds.minimum_error_threshold(pixels(spark, sf_dir)), "threshold")


@query(f"""WITH {PIXELS_SQL}, r AS (SELECT frame, y, x, x - row_number() OVER (PARTITION BY frame, y ORDER BY x) AS island FROM pixels WHERE v >= 4)
    SELECT frame, y, min(x) AS "start", max(x) AS stop FROM r GROUP BY frame, y, island""")
def rle_runs(spark, sf_dir):
    return images.runs(pixels(spark, sf_dir), 4)


@query(f"WITH {PIXELS_SQL} SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY abs(v) DESC, y, x) AS INTEGER) AS rank, y, x, v FROM pixels WHERE v >= 10")
def seed_ranking(spark, sf_dir):
    return images.ranked_seeds(pixels(spark, sf_dir), 10)




def _facet_sql(table: str = "pixels", before: str = PIXELS_SQL) -> str:
    names = {(-1, -1): "nw", (-1, 0): "nn", (-1, 1): "ne", (0, -1): "ww", (0, 0): "cc", (0, 1): "ee", (1, -1): "sw", (1, 0): "ss", (1, 1): "se"}
    picks = ", ".join(f"max(CASE WHEN o.dy = {dy} AND o.dx = {dx} THEN q.v END) AS {n}" for (dy, dx), n in names.items())
    return f"""{before}, fs AS (SELECT *, max(y) OVER (PARTITION BY frame) + 1 AS h, max(x) OVER (PARTITION BY frame) + 1 AS w FROM {table}),
        off(dy, dx) AS (VALUES {', '.join(f'({dy}, {dx})' for dy, dx in names)}),
        o AS MATERIALIZED (SELECT p.frame, p.y, p.x, dy, dx, {mirrored('p.y + dy', 'p.h')} AS yy, {mirrored('p.x + dx', 'p.w')} AS xx FROM fs p CROSS JOIN off),
        nb AS (SELECT o.frame, o.y, o.x, {picks} FROM o JOIN {table} q ON q.frame = o.frame AND q.y = o.yy AND q.x = o.xx GROUP BY ALL),
        f AS (SELECT *, (-nw + 2 * nn - ne + 2 * ww + 5 * cc + 2 * ee - sw + 2 * ss - se) / 9 AS d, (sw + ss + se - nw - nn - ne) / 6 AS dr, (ne + ee + se - nw - ww - sw) / 6 AS dc,
              (nw + nn + ne - 2 * (ww + cc + ee) + sw + ss + se) / 6 AS drr, (nw - ne - sw + se) / 4 AS drc, (nw + ww + sw - 2 * (nn + cc + ss) + ne + ee + se) / 6 AS dcc FROM nb)"""


@query(f"WITH {_facet_sql()} SELECT frame, y, x, round(d + 0.25 * dr - 0.375 * dc + 0.0625 * drr - 0.09375 * drc + 0.140625 * dcc, 6) + 0 AS value FROM f")
def facet_response(spark, sf_dir):
    f = images.facet(pixels(spark, sf_dir)).withColumn("value", images.facet_value(F.col("y") + 0.25, F.col("x") - 0.375))
    return rounded(f.select("frame", "y", "x", "value"), "value")


@query(f"""WITH {PIXELS_SQL}, o AS (SELECT frame, y, x, y + 0.25 AS py, x + 0.75 AS px FROM pixels)
    SELECT o.frame, o.y, o.x, round(0.75 * 0.25 * coalesce(a.v, 0) + 0.75 * 0.75 * coalesce(b.v, 0) + 0.25 * 0.25 * coalesce(c.v, 0) + 0.25 * 0.75 * coalesce(d.v, 0), 6) + 0 AS value
    FROM o LEFT JOIN pixels a ON (a.frame, a.y, a.x) = (o.frame, o.y, o.x) LEFT JOIN pixels b ON (b.frame, b.y, b.x) = (o.frame, o.y, o.x + 1)
    LEFT JOIN pixels c ON (c.frame, c.y, c.x) = (o.frame, o.y + 1, o.x) LEFT JOIN pixels d ON (d.frame, d.y, d.x) = (o.frame, o.y + 1, o.x + 1)""")
def bilinear_values(spark, sf_dir):
    p = pixels(spark, sf_dir)
    points = p.select("frame", "y", "x", (F.col("y") + 0.25).alias("py"), (F.col("x") + 0.75).alias("px"))
    return rounded(images.bilinear(points, p).select("frame", "y", "x", "value"), "value")


@query(f"WITH {PIXELS_SQL} SELECT frame, y, x, sum(v) OVER (PARTITION BY y, x ORDER BY frame ROWS UNBOUNDED PRECEDING) AS v FROM pixels")
def cumulative_projection(spark, sf_dir):
    return images.cumulative_projection(pixels(spark, sf_dir))


@query(f"""WITH {PIXELS_SQL}, c AS MATERIALIZED (SELECT frame, y, x, sum(v) OVER (PARTITION BY y, x ORDER BY frame ROWS UNBOUNDED PRECEDING) AS v FROM pixels),
    r AS (SELECT frame, v, row_number() OVER (PARTITION BY frame ORDER BY v) - 1 AS pl, count(*) OVER (PARTITION BY frame) AS n FROM c),
    e AS (SELECT frame, max(CASE WHEN pl = floor(n * 0.00175::DOUBLE) THEN v END) AS lo, max(CASE WHEN pl = n - 1 - floor(n * 0.00175::DOUBLE) THEN v END) AS hi FROM r GROUP BY frame)
    SELECT frame, y, x, floor(least(1, greatest(0, coalesce((v - lo) / nullif(hi - lo, 0), 0))) * 255 + 0.5) AS v FROM c JOIN e USING (frame)""")
def projection_levels(spark, sf_dir):
    return images.projection_levels(pixels(spark, sf_dir), saver(spark))


@query(f"""WITH {PIXELS_SQL}, per AS (SELECT frame, v, count(*) AS n FROM pixels GROUP BY ALL),
    m AS (SELECT frame, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, v) AS k FROM per) WHERE k = 1)
    SELECT frame, round(stddev_samp(v), 6) + 0 AS sd, max(v) AS most, max(mode) AS mode FROM pixels JOIN m USING (frame) GROUP BY frame""")
def value_statistics(spark, sf_dir):
    return rounded(images.value_statistics(pixels(spark, sf_dir)), "sd")


SORTED = f"{PIXELS_SQL}, ranked AS (SELECT frame, v, row_number() OVER (PARTITION BY frame ORDER BY v) - 1 AS pl, count(*) OVER (PARTITION BY frame) AS n FROM pixels)"


@query(f"""WITH {SORTED}, q AS (SELECT frame, n, max(CASE WHEN pl = least(floor(n * 0.25 + 0.5), n - 1) THEN v END) AS lo, max(CASE WHEN pl = least(floor(n * 0.75 + 0.5), n - 1) THEN v END) AS hi, max(v) - min(v) AS span FROM ranked GROUP BY frame, n)
    SELECT frame, CAST(floor(span / nullif(2 * (hi - lo) * pow(n, -1.0 / 3), 0) + 0.5) AS BIGINT) AS bins FROM q""")
def freedman_diaconis(spark, sf_dir):
    return images.bin_count(pixels(spark, sf_dir), saver(spark))


@query(f"WITH {SORTED} SELECT frame, v AS level FROM ranked WHERE pl = least(floor(n * (1 - 2.0::DOUBLE / 100) + 0.5), n - 1)")
def saturation_level(spark, sf_dir):
    return images.saturation_level(pixels(spark, sf_dir), 2.0, saver(spark))


def _lines_sql(radius: int, n: int) -> str:
    offsets = ", ".join(f"({k}, {q}, {dx}, {dy})" for k, q, dx, dy in kernels.line_offsets(radius, n))
    return f"""{PIXELS_SQL}, off(k, q, dx, dy) AS (VALUES {offsets}),
        beside AS MATERIALIZED (SELECT p.frame, p.y, p.x, o.k, o.q, p.y - o.dy AS ny, p.x + o.dx AS nx FROM pixels p CROSS JOIN off o),
        sums AS MATERIALIZED (SELECT p.frame, p.y, p.x, p.k, sum(n.v) AS s FROM beside p JOIN pixels n ON n.frame = p.frame AND n.y = p.ny AND n.x = p.nx GROUP BY ALL),
        best AS (SELECT *, row_number() OVER (PARTITION BY frame, y, x ORDER BY s DESC, k) AS place FROM sums),
        lft AS MATERIALIZED (SELECT frame, y, x, CASE WHEN s > 0 THEN s / {2 * radius + 1} ELSE 0 END AS response, CASE WHEN s > 0 THEN -{HALF}::DOUBLE + k * {PI}::DOUBLE / {n} ELSE 0 END AS orientation FROM best WHERE place = 1)"""


@query(f"WITH {_lines_sql(10, 20)} SELECT frame, y, x, round(response, 6) + 0 AS response, round(orientation, 6) + 0 AS orientation FROM lft")
def lft(spark, sf_dir):
    return rounded(orientation.line_filter(pixels(spark, sf_dir)), "response", "orientation")


@query(f"""WITH {_lines_sql(10, 20)},
    votes AS MATERIALIZED (SELECT p.frame, p.y, p.x, p.k, sum(cos(2 * (n.orientation - (-{HALF}::DOUBLE + p.k * {PI}::DOUBLE / 20)))) AS s FROM beside p JOIN lft n ON n.frame = p.frame AND n.y = p.ny AND n.x = p.nx GROUP BY ALL)
    SELECT frame, y, x, round(greatest(0, max(s * response)), 5) + 0 AS v FROM votes JOIN lft USING (frame, y, x) GROUP BY ALL""")
def oft(spark, sf_dir):
    return rounded(orientation.orientation_filter(orientation.line_filter(pixels(spark, sf_dir))), "v", digits=5)




@query(f"""WITH {_lines_sql(2, 6)},
    cube AS MATERIALIZED (SELECT frame, y, x, k, s / 5 - avg(s / 5) OVER (PARTITION BY frame, y, x) AS m FROM sums),
    pairs AS MATERIALIZED (SELECT p.frame, p.y, p.x, p.ny, p.nx, b.k, b.m * pow(abs(p.q), -0.1) * exp(-pow(acos(least(1, abs(cos({PI}::DOUBLE / 6 * (p.k - b.k))))) / (1.41 * 0.26), 2)) AS w
        FROM beside p JOIN cube b ON b.frame = p.frame AND b.y = p.y AND b.x = p.x WHERE p.q <> 0 AND b.m > 0),
    got AS (SELECT p.frame, p.y, p.x, sum(p.w * n.m) AS v FROM pairs p JOIN cube n ON n.frame = p.frame AND n.y = p.ny AND n.x = p.nx AND n.k = p.k GROUP BY ALL)
    SELECT p.frame, p.y, p.x, round(coalesce(g.v, 0), 4) + 0 AS v FROM pixels p LEFT JOIN got g ON g.frame = p.frame AND g.y = p.y AND g.x = p.x""")
def oft_vote(spark, sf_dir):
    return rounded(orientation.orientation_vote(pixels(spark, sf_dir), 2, 6), "v", digits=4)


@query()
def oft_vote_wide(spark, sf_dir):
    return rounded(orientation.orientation_vote(pixels(spark, sf_dir)), "v", digits=4)


@query(f"""WITH {CURVES_SQL} SELECT frame, contour, point, round({wrap_sql('angle * 3')}, 6) + 0 AS wrapped, round({wrap_sql('1.25::DOUBLE - angle')}, 6) + 0 AS turn,
    round({wrap_sql(f"angle + 0.5::DOUBLE * {wrap_sql('1.25::DOUBLE - angle')}")}, 6) + 0 AS middle, round({wrap_sql(f"angle + 0.75::DOUBLE * {wrap_sql('1.25::DOUBLE - angle')}")}, 6) + 0 AS quarter,
    round({wrap_sql('angle + 1.25::DOUBLE')}, 6) + 0 AS added, round(least(abs({wrap_sql('1.25::DOUBLE - angle')}), {PI}::DOUBLE - abs({wrap_sql('1.25::DOUBLE - angle')})), 6) + 0 AS gap FROM curves""")
def axial_angles(spark, sf_dir):
    a, b = F.col("angle"), F.lit(1.25)
    p = curve_points(spark, sf_dir).select("frame", "contour", "point", angles.wrap(a * 3).alias("wrapped"), angles.difference(a, b).alias("turn"), angles.average(a, b).alias("middle"), angles.weighted(a, b, F.lit(0.25)).alias("quarter"), angles.add(a, b).alias("added"), angles.axial_gap(a, b).alias("gap"))
    return rounded(p, "wrapped", "turn", "middle", "quarter", "added", "gap")


_ISLAND_ROWS = "rows AS (SELECT o_orderkey AS k, CAST(o_orderkey // 64 % 3 AS INTEGER) AS frame, CAST(o_orderkey // 5 % 7 AS INTEGER) AS contour FROM orders)"


@query(f"""WITH {_ISLAND_ROWS}, c AS (SELECT *, CASE WHEN frame IS NOT DISTINCT FROM lag(frame) OVER (ORDER BY k) AND k > (SELECT min(k) FROM rows) THEN 0 ELSE 1 END AS s, CASE WHEN contour IS NOT DISTINCT FROM lag(contour) OVER (ORDER BY k) THEN 0 ELSE 1 END AS t FROM rows)
    SELECT k, frame, contour, CAST(sum(s) OVER w AS BIGINT) AS set_no, CAST(sum(greatest(s, t)) OVER w AS BIGINT) AS curve_no FROM c WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def curve_islands(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.expr("cast(o_orderkey div 64 % 3 as int)").alias("frame"), F.expr("cast(o_orderkey div 5 % 7 as int)").alias("contour"))
    return curves.curve_islands(o, "k")


@query(f"WITH {CURVES_SQL} SELECT frame, contour, count(*) AS n_points FROM curves GROUP BY ALL")
def curve_stats(spark, sf_dir):
    return curves.curve_sizes(curve_points(spark, sf_dir))


@query(f"WITH {CURVES_SQL} SELECT frame, contour, point, 'contour_f_' || frame || '_c_' || contour AS label FROM curves")
def curve_labels(spark, sf_dir):
    return curves.labelled(curve_points(spark, sf_dir)).select("frame", "contour", "point", "label")


@query(f"""WITH {CURVES_SQL}, few AS (SELECT frame, contour * 3 + 2 AS contour, point * 2 AS point, x, y FROM curves), n AS (SELECT frame, contour, row_number() OVER (PARTITION BY frame ORDER BY contour) AS c FROM (SELECT DISTINCT frame, contour FROM few))
    SELECT frame, CAST(c AS INTEGER) AS contour, CAST(row_number() OVER (PARTITION BY frame, c ORDER BY point) AS INTEGER) AS point, x, y FROM few JOIN n USING (frame, contour)""")
def renumber_curves(spark, sf_dir):
    some = curve_points(spark, sf_dir).selectExpr("frame", "contour * 3 + 2 as contour", "point * 2 as point", "x", "y")
    return curves.renumbered(some)


@query(f"WITH {CURVES_SQL} SELECT frame, contour, point, x, y FROM curves QUALIFY count(*) OVER (PARTITION BY frame, contour) >= 12")
def min_nodes_filter(spark, sf_dir):
    return curves.with_min_points(curve_points(spark, sf_dir), 12).select("frame", "contour", "point", "x", "y")


@query(f"""WITH {CURVES_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY frame, contour) AS n, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM curves WINDOW w AS (PARTITION BY frame, contour ORDER BY point)),
    t AS (SELECT *, max(CASE WHEN point = (n - 1) // 2 + CASE WHEN n % 2 = 1 THEN 0 ELSE 1 END AND point < n THEN dx * cos(angle) - dy * sin(angle) END) OVER (PARTITION BY frame, contour) AS turn FROM s)
    SELECT frame, contour, point, round(CASE WHEN turn < 0 THEN angle + {PI}::DOUBLE - floor((angle + {PI}::DOUBLE) / {2 * math.pi!r}::DOUBLE) * {2 * math.pi!r}::DOUBLE ELSE angle END, 6) + 0 AS angle FROM t""")
def orient_normals(spark, sf_dir):
    return rounded(curves.oriented_normals(curve_points(spark, sf_dir)).select("frame", "contour", "point", "angle"), "angle")


@query(f"""WITH {CURVES_SQL}, cut AS (SELECT *, CASE WHEN (contour + point) % 5 = 0 THEN 1 ELSE 0 END AS c FROM curves),
    b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY frame, contour ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cut),
    u AS (SELECT frame, contour, point, CAST(before AS INTEGER) AS part FROM b UNION ALL SELECT frame, contour, point, CAST(before + 1 AS INTEGER) FROM b WHERE c = 1)
    SELECT frame, contour, point, part FROM u QUALIFY count(*) OVER (PARTITION BY frame, contour, part) > 1 OR max(part) OVER (PARTITION BY frame, contour) = 0""")
def split_at_junctions(spark, sf_dir):
    p = curve_points(spark, sf_dir)
    return curves.split_at(p, p.where("(contour + point) % 5 = 0")).select("frame", "contour", "point", "part")


@query(f"""WITH {CURVES_SQL}, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM curves WINDOW w AS (PARTITION BY frame, contour ORDER BY point)),
    l AS (SELECT *, sum(step) OVER (PARTITION BY frame, contour ORDER BY point ROWS UNBOUNDED PRECEDING) AS len FROM s),
    k AS (SELECT a.*, b.width AS w0, b.len AS s0, c.width AS w1, c.len AS s1 FROM l a
          ASOF LEFT JOIN (SELECT frame, contour, point, width, len FROM l WHERE width IS NOT NULL) b ON a.frame = b.frame AND a.contour = b.contour AND a.point >= b.point
          ASOF LEFT JOIN (SELECT frame, contour, point, width, len FROM l WHERE width IS NOT NULL) c ON a.frame = c.frame AND a.contour = c.contour AND a.point <= c.point)
    SELECT frame, contour, point, round(coalesce(width, w0 + coalesce((len - s0) / nullif(s1 - s0, 0), 0) * (w1 - w0), w0, w1), 6) + 0 AS width FROM k""")
def gap_fill(spark, sf_dir):
    return rounded(curves.gaps_filled(curve_points(spark, sf_dir), "width").select("frame", "contour", "point", "width"), "width")


_SLOPE = lambda x: f"(-({x}) / 3.24::DOUBLE * exp(-0.5 * (({x}) / 1.8::DOUBLE) * (({x}) / 1.8::DOUBLE)) / {math.sqrt(2 * math.pi) * 1.8!r}::DOUBLE)"


@query(f"""WITH {CURVES_SQL} SELECT frame, contour, point, round(CASE WHEN width < 0.1 THEN 0 ELSE coalesce(response / nullif(abs({_SLOPE('0.125 + width')} + (0.25 - 1) * {_SLOPE('0.125 - width')}), 0), 0) END, 5) + 0 AS contrast FROM curves""")
def contrast(spark, sf_dir):
    p = curve_points(spark, sf_dir)
    return rounded(p.select("frame", "contour", "point", curves.true_contrast(F.col("response"), F.col("width"), F.lit(0.125), F.lit(0.25), 1.8).alias("contrast")), "contrast", digits=5)


@query()
def width_lookup(spark, sf_dir):
    p = curve_points(spark, sf_dir).select("frame", "contour", "point", (F.col("width") * 1.5 + 1).alias("width_l"), (F.col("width") + 1.5).alias("width_r"), F.col("response").alias("grad_l"), (F.col("response") / 2 + 1).alias("grad_r"))
    return rounded(curves.corrected_widths(p).select("frame", "contour", "point", "width", "asymmetry", "correction"), "width", "asymmetry", "correction")


@query(f"""WITH {CURVES_SQL} SELECT frame, contour, count(*) AS n_points, contour % 8 AS colour, round(sum(point * (x + y)), 6) + 0 AS digest FROM curves GROUP BY ALL""")
def polyline_geometry(spark, sf_dir):
    lines = curves.polylines(curve_points(spark, sf_dir))
    digest = F.aggregate(F.transform("path", lambda p, i: (i + 1) * (p.x + p.y)), F.lit(0.0), lambda a, b: a + b)
    return rounded(lines.select("frame", "contour", "n_points", "colour", digest.alias("digest")), "digest")


@query(f"WITH {CURVES_SQL} SELECT frame, contour, round(avg(CASE WHEN response > 3 THEN width END), 6) + 0 AS mean_width FROM curves GROUP BY ALL")
def mean_widths(spark, sf_dir):
    return rounded(curves.mean_widths(curve_points(spark, sf_dir), good=F.col("response") > 3), "mean_width")


@query(f"WITH {CURVES_SQL} SELECT frame, contour, point, round(x - 2 * width * sin(angle), 6) + 0 AS x_left, round(y - 2 * width * cos(angle), 6) + 0 AS y_left, round(x + 2 * width * sin(angle), 6) + 0 AS x_right, round(y + 2 * width * cos(angle), 6) + 0 AS y_right FROM curves")
def width_border(spark, sf_dir):
    found = curves.borders(curve_points(spark, sf_dir), 2 * F.col("width"))
    return rounded(found.select("frame", "contour", "point", "x_left", "y_left", "x_right", "y_right"), "x_left", "y_left", "x_right", "y_right")


@query(f"WITH {CURVES_SQL} SELECT frame, contour, point, round(x - 3 * sin(angle), 6) + 0 AS x_left, round(y - 3 * cos(angle), 6) + 0 AS y_left, round(x + 3 * sin(angle), 6) + 0 AS x_right, round(y + 3 * cos(angle), 6) + 0 AS y_right FROM curves")
def normal_vectors(spark, sf_dir):
    found = curves.borders(curve_points(spark, sf_dir), F.lit(3.0))
    return rounded(found.select("frame", "contour", "point", "x_left", "y_left", "x_right", "y_right"), "x_left", "y_left", "x_right", "y_right")


@query(f"""WITH {CURVES_SQL}, cells AS MATERIALIZED (SELECT frame, contour, point, x, y, {cells_sql(4)} FROM curves), near AS MATERIALIZED {beside_sql("cells")}
    SELECT a.frame, a.contour, a.point, count(*) AS n FROM near a JOIN cells b ON b.cx = a.nx AND b.cy = a.ny WHERE abs(a.x - b.x) <= 3.000000001 AND abs(a.y - b.y) <= 3.000000001 GROUP BY ALL""")
def box_neighbours(spark, sf_dir):
    p = curve_points(spark, sf_dir).select("frame", "contour", "point", "x", "y")
    return spatial.box_join(p, p, 3.0).groupBy(*(F.col(f"l.{c}").alias(c) for c in ("frame", "contour", "point"))).agg(F.count("*").alias("n"))


_SHIFTED = f"""{CURVES_SQL}, cells AS MATERIALIZED (SELECT frame, contour, point, x, y, angle, {cells_sql(8)} FROM curves), near AS MATERIALIZED {beside_sql("cells")},
    p AS MATERIALIZED (SELECT a.frame, a.contour, a.point, a.x, a.y, a.angle - b.angle AS turn, b.x AS bx, b.y AS byy FROM near a JOIN cells b ON b.cx = a.nx AND b.cy = a.ny WHERE abs(a.x - b.x) <= 6.000000001 AND abs(a.y - b.y) <= 6.000000001),
    w AS (SELECT *, exp(-0.5 * pow({wrap_sql('turn')} / 0.4363323129985824, 2)) * exp(-0.5 * ((x - bx) * (x - bx) + (y - byy) * (y - byy)) / 4) AS w FROM p)"""


@query(f"""WITH {_SHIFTED}
    SELECT frame, contour, point, round(CASE WHEN count(*) > 1 THEN sum(w * bx) / sum(w) ELSE max(x) END, 5) + 0 AS x, round(CASE WHEN count(*) > 1 THEN sum(w * byy) / sum(w) ELSE max(y) END, 5) + 0 AS y FROM w GROUP BY ALL""")
def mean_shift_curves(spark, sf_dir):
    return _shifted(spark, sf_dir, 2.0)


@query()
def mean_shift_curves_wide(spark, sf_dir):
    return _shifted(spark, sf_dir, 5.0)


def _shifted(spark, sf_dir, radius):
    p = curve_points(spark, sf_dir).select("frame", "contour", "point", "x", "y", "angle")
    return rounded(spatial.mean_shift_curves(p, ["frame", "contour", "point"], radius).select("frame", "contour", "point", "x", "y"), "x", "y", digits=5)


_IMAGE_POINTS = "pts AS (SELECT frame, y AS i, x AS j, x + 0.25::DOUBLE AS x, y + 0.5::DOUBLE AS y, 0.1::DOUBLE * CAST((x + y) % 30 AS DOUBLE) - 1.5::DOUBLE AS angle FROM pixels)"
_IMAGE_TURN = wrap_sql("atan2(p.y - a.y, p.x - a.x) - a.angle")


@query(f"""WITH {PIXELS_SQL}, {_IMAGE_POINTS}, w AS (SELECT a.frame, a.i, a.j, a.x, a.y, p.x AS px, p.y AS py, p.v, min(p.v) OVER (PARTITION BY a.frame, a.i, a.j) AS least, {_IMAGE_TURN} / 0.4363323129985824 AS t, ((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y)) / 4 AS q
        FROM pts a JOIN pixels p ON p.frame = a.frame AND p.x BETWEEN a.x - 6 AND a.x + 6 AND p.y BETWEEN a.y - 6 AND a.y + 6),
    s AS (SELECT frame, i, j, max(x) AS x, max(y) AS y, sum(exp(-0.5 * t * t) * exp(-0.5 * q) * (v - least)) AS s, sum(exp(-0.5 * t * t) * exp(-0.5 * q) * (v - least) * px) AS sx, sum(exp(-0.5 * t * t) * exp(-0.5 * q) * (v - least) * py) AS sy FROM w GROUP BY ALL)
    SELECT frame, i, j, round(coalesce(sx / nullif(s, 0), x), 5) + 0 AS x, round(coalesce(sy / nullif(s, 0), y), 5) + 0 AS y FROM s""")
def mean_shift_image(spark, sf_dir):
    p = pixels(spark, sf_dir)
    points = p.select("frame", F.col("y").alias("i"), F.col("x").alias("j"), (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"), (F.lit(0.1) * ((F.col("x") + F.col("y")) % 30).cast("double") - F.lit(1.5)).alias("angle"))
    return rounded(spatial.mean_shift_image(points, p, ["frame", "i", "j"], 2).select("frame", "i", "j", "x", "y"), "x", "y", digits=5)


@query(f"""WITH {CURVES_SQL}, cells AS MATERIALIZED (SELECT frame, contour, point, x, y, {cells_sql(6)} FROM curves), near AS MATERIALIZED (SELECT *, frame + 1 AS nf FROM {beside_sql("cells")}),
    n AS (SELECT a.frame AS pair, a.contour AS c1, a.point AS p1, b.contour AS c2, b.point AS p2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM near a JOIN cells b ON b.frame = a.nf AND b.cx = a.nx AND b.cy = a.ny WHERE abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6)
    SELECT pair, c1, p1, c2, p2, round(d, 6) + 0 AS d FROM n WHERE d < 6 QUALIFY row_number() OVER (PARTITION BY pair, c1, p1 ORDER BY d, c2, p2) = 1""")
def nearest_point(spark, sf_dir):
    first, second = _neighbours(curve_points(spark, sf_dir).select("frame", "contour", "point", "x", "y"))
    near = spatial.nearest(first, second, 6.0, ["pair", "contour", "point"], ["contour", "point"], ["pair"])
    return rounded(near.select(F.col("l.pair").alias("pair"), F.col("l.contour").alias("c1"), F.col("l.point").alias("p1"), F.col("r.contour").alias("c2"), F.col("r.point").alias("p2"), "d"), "d")


def _rings_sql(sizes: tuple[int, ...]) -> str:
    """CTEs up to `every`: for each point the nearest one of the next frame, looked for in wider and wider cells."""
    out = [CURVES_SQL, "todo0 AS MATERIALIZED (SELECT frame AS pair, contour, point, x, y FROM curves WHERE frame < 4)"]
    for k, size in enumerate(sizes):
        cells = f"CAST(floor(x / {size}) AS BIGINT) AS cx, CAST(floor(y / {size}) AS BIGINT) AS cy"
        out += [
            f"left{k} AS (SELECT *, {cells} FROM todo{k})", f"near{k} AS MATERIALIZED {beside_sql(f'left{k}')}", f"right{k} AS MATERIALIZED (SELECT frame - 1 AS pair, contour AS c2, point AS p2, x AS bx, y AS byy, {cells} FROM curves)",
            f"d{k} AS (SELECT a.pair, a.contour, a.point, c2, p2, sqrt((a.x - bx) * (a.x - bx) + (a.y - byy) * (a.y - byy)) AS d FROM near{k} a JOIN right{k} b ON b.pair = a.pair AND b.cx = a.nx AND b.cy = a.ny)",
            f"best{k} AS MATERIALIZED (SELECT pair, contour, point, min(struct_pack(d, c2, p2)) AS b FROM d{k} WHERE d <= {size} GROUP BY ALL)",
            f"todo{k + 1} AS MATERIALIZED (SELECT * FROM todo{k} ANTI JOIN best{k} USING (pair, contour, point))",
        ]
    return ", ".join(out) + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM best{k}" for k in range(len(sizes))) + ")"


@query(f"WITH {_rings_sql((6, 40, 400, 100000))} SELECT pair, contour AS c1, point AS p1, b.c2 AS c2, b.p2 AS p2, round(b.d, 6) + 0 AS d FROM every")
def nearest_any(spark, sf_dir):
    first, second = _neighbours(curve_points(spark, sf_dir).select("frame", "contour", "point", "x", "y"))
    near = spatial.nearest_any(first.where("frame < 4"), second, ["pair", "contour", "point"], ["contour", "point"], saver(spark), ["pair"])
    return rounded(near.select(F.col("l.pair").alias("pair"), F.col("l.contour").alias("c1"), F.col("l.point").alias("p1"), F.col("r.contour").alias("c2"), F.col("r.point").alias("p2"), "d"), "d")


MATCHES = f"""{CURVES_SQL}, ix AS MATERIALIZED (SELECT *, point - 1 AS i, count(*) OVER (PARTITION BY frame, contour) AS n, {cells_sql(4)} FROM curves),
    near AS MATERIALIZED (SELECT frame AS pair, frame + 1 AS nf, contour AS c1, n AS n1, i, x, y, angle, nx, ny FROM {beside_sql("ix")}),
    cand AS MATERIALIZED (SELECT a.pair, a.c1, a.n1, a.i, b.contour AS c2, b.n AS n2, b.i AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, b.angle - a.angle AS turn FROM near a JOIN ix b ON b.frame = a.nf AND b.cx = a.nx AND b.cy = a.ny
             WHERE abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4),
    m AS MATERIALIZED (SELECT pair, c1, any_value(n1) AS n1, i, c2, any_value(n2) AS n2, arg_min(j, struct_pack(d, j)) AS j, min(d) AS d FROM cand WHERE d < 4 AND abs({wrap_sql('turn')}) < {math.pi / 4!r}::DOUBLE GROUP BY pair, c1, i, c2)"""

RUNS = f"""{MATCHES}, st AS (SELECT *, sign(j - lag(j) OVER (PARTITION BY pair, c1, c2 ORDER BY i)) AS step FROM m),
    dr AS (SELECT *, last_value(nullif(step, 0) IGNORE NULLS) OVER (PARTITION BY pair, c1, c2 ORDER BY i ROWS UNBOUNDED PRECEDING) AS dir FROM st),
    tn AS (SELECT *, coalesce(dir <> lag(dir) OVER (PARTITION BY pair, c1, c2 ORDER BY i), false) AS turn FROM dr),
    rn AS MATERIALIZED (SELECT *, sum(turn::INT) OVER (PARTITION BY pair, c1, c2 ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM tn),
    sz AS (SELECT pair, c1, c2, run, count(*) AS size FROM rn GROUP BY ALL),
    bt AS (SELECT pair, c1, c2, arg_min(run, struct_pack(s := -size, r := run)) AS run FROM sz GROUP BY pair, c1, c2),
    runs AS MATERIALIZED (SELECT pair, c1, n1, i, c2, n2, j, d FROM rn SEMI JOIN bt USING (pair, c1, c2, run))"""

OVERLAPS = f"""{RUNS}, jp AS (SELECT *, coalesce(greatest(abs(i - lag(i) OVER w), abs(j - lag(j) OVER w)), 0) AS jump FROM runs WINDOW w AS (PARTITION BY pair, c1, c2 ORDER BY i)),
    ov AS (SELECT pair, c1, c2, max(n1) AS n1, max(n2) AS n2, count(*) AS size, min(i) AS lo1, max(i) AS hi1, min(j) AS lo2, max(j) AS hi2, arg_min(j, i) < arg_max(j, i) AS same, max(jump) AS most FROM jp GROUP BY pair, c1, c2),
    ed AS (SELECT *, CASE WHEN hi1 / n1 >= 1 - 0.08::DOUBLE THEN 1 WHEN lo1 / n1 <= 0.08::DOUBLE THEN 0 END AS e1, CASE WHEN hi2 / n2 >= 1 - 0.08::DOUBLE THEN 1 WHEN lo2 / n2 <= 0.08::DOUBLE THEN 0 END AS e2 FROM ov),
    kinds AS (SELECT pair, c1, c2, size, lo1, hi1, lo2, hi2, same, round(most / size, 6) + 0 AS jump, CASE WHEN size < 5 THEN 'none' WHEN greatest((hi1 - lo1 + 1) / n1, (hi2 - lo2 + 1) / n2) >= 0.7::DOUBLE THEN CASE WHEN most / size <= 0.5 THEN 'full' ELSE 'none' END
        WHEN e1 IS NULL OR e2 IS NULL THEN 'cross' WHEN CASE WHEN same THEN e1 = e2 ELSE e1 <> e2 END THEN 'branching' WHEN most / size <= 0.5 THEN 'extension' ELSE 'none' END AS kind FROM ed)"""


def _neighbours(points):
    """(first, second): the points of each frame, and of the frame after it, under a shared `pair`."""
    return points.withColumn("pair", F.col("frame")), points.withColumn("pair", F.col("frame") - 1)


def _matches(spark, sf_dir):
    return linking.matches(*_neighbours(linking.indexed(curve_points(spark, sf_dir))), keys=["pair"])


@query(f"WITH {MATCHES} SELECT pair, c1, i, c2, j, round(d, 6) + 0 AS d FROM m")
def overlap_match(spark, sf_dir):
    return rounded(_matches(spark, sf_dir).select("pair", "c1", "i", "c2", "j", "d"), "d")


@query(f"WITH {RUNS} SELECT pair, c1, i, c2, j FROM runs")
def overlap_runs(spark, sf_dir):
    return linking.longest_runs(_matches(spark, sf_dir), ["pair"]).select("pair", "c1", "i", "c2", "j")


@query(f"""WITH {RUNS} SELECT r.pair, r.c1, r.c2, r.i, round((a.x + b.x) / 2, 6) + 0 AS x, round((a.y + b.y) / 2, 6) + 0 AS y, round(max(r.d) OVER (PARTITION BY r.pair, r.c1, r.c2), 6) + 0 AS furthest
    FROM runs r JOIN ix a ON a.frame = r.pair AND a.contour = r.c1 AND a.i = r.i JOIN ix b ON b.frame = r.pair + 1 AND b.contour = r.c2 AND b.i = r.j""")
def overlap_points(spark, sf_dir):
    first, second = _neighbours(linking.indexed(curve_points(spark, sf_dir)))
    found = linking.longest_runs(linking.matches(first, second, keys=["pair"]), ["pair"])
    return rounded(linking.overlap_points(found, first, second, ["pair"]), "x", "y", "furthest")


def _overlaps(spark, sf_dir):
    return linking.overlaps(linking.longest_runs(_matches(spark, sf_dir), ["pair"]), ["pair"])


@query(f"WITH {OVERLAPS} SELECT * FROM kinds")
def overlap_type(spark, sf_dir):
    return rounded(_overlaps(spark, sf_dir).select("pair", "c1", "c2", "size", "lo1", "hi1", "lo2", "hi2", "same", "jump", "kind"), "jump")


def _edges(spark, sf_dir):
    return _overlaps(spark, sf_dir).where("kind in ('full', 'extension')")


@query(f"""WITH RECURSIVE {OVERLAPS}, e AS (SELECT pair || ':' || lpad(c1::VARCHAR, 12, '0') AS u, (pair + 1) || ':' || lpad(c2::VARCHAR, 12, '0') AS v FROM kinds WHERE kind IN ('full', 'extension')),
    b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), reach(node, other) AS (SELECT u, u FROM b UNION SELECT r.node, b.v FROM reach r JOIN b ON b.u = r.other)
    SELECT node, min(other) AS component FROM reach GROUP BY node""")
def link_components(spark, sf_dir):
    return linking.link_components(_edges(spark, sf_dir), saver(spark), F.col("pair"), F.col("pair") + 1)


@query(f"""WITH {OVERLAPS}, linked AS (SELECT DISTINCT pair AS frame, c1 AS contour FROM kinds WHERE kind IN ('full', 'extension'))
    SELECT frame, contour, point, x, y FROM curves ANTI JOIN linked USING (frame, contour)""")
def unmatched_curves(spark, sf_dir):
    mine = curve_points(spark, sf_dir).select("frame", "contour", "point", "x", "y")
    return linking.unmatched(mine, _edges(spark, sf_dir).withColumn("frame", F.col("pair")), "c1", ["frame"])


@query()
def merge_pairs(spark, sf_dir):
    p = curve_points(spark, sf_dir)
    return rounded(linking.link_two(p.where("frame = 1"), p.where("frame = 2"), saver(spark)), "x", "y", "angle", "response", digits=5)


@query()
def link_incremental(spark, sf_dir):
    return rounded(linking.link_incrementally(curve_points(spark, sf_dir), [1, 2, 3, 4], saver(spark)), "x", "y", "angle", "response", digits=5)


@query()
def link_pairwise(spark, sf_dir):
    return rounded(linking.link_pairwise(curve_points(spark, sf_dir), [1, 2, 3, 4], saver(spark)), "x", "y", "angle", "response", digits=5)


def _placed(spark, sf_dir):
    """Curve points dealt over all images and their rows."""
    frames = pixels(spark, sf_dir).agg(F.max("frame").alias("frames"))
    p = curve_points(spark, sf_dir).withColumn("curve", F.col("contour") * 4 + F.col("frame")).join(frames)  # one row
    return p.selectExpr("cast(curve % frames + 1 as int) as frame", "curve", "point", "x % 64 as x", "y % 64 as y", "angle")


PLACED = f"{PIXELS_SQL}, {CURVES_SQL}, placed AS (SELECT CAST((contour * 4 + frame) % (SELECT max(frame) FROM pixels) + 1 AS INTEGER) AS frame, contour * 4 + frame AS curve, point, x % 64 AS x, y % 64 AS y, angle FROM curves)"
PROFILES = f"""{PLACED}, s AS (SELECT p.*, i, x + (i - 3.5) * sin(angle) - (j - 1) * cos(angle) AS px, y + (i - 3.5) * cos(angle) + (j - 1) * sin(angle) AS py FROM placed p, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(3)) AS j)),
    c AS (SELECT s.*, floor(py) AS fy, floor(px) AS fx FROM s),
    b AS (SELECT c.curve, c.point, c.i, sum(coalesce(q.v, 0) * CASE WHEN a.k = 1 THEN py - fy ELSE 1 - (py - fy) END * CASE WHEN b.k = 1 THEN px - fx ELSE 1 - (px - fx) END) / 3 AS v
          FROM c, (VALUES (0), (1)) a(k), (VALUES (0), (1)) b(k) LEFT JOIN pixels q ON q.frame = c.frame AND q.y = CAST(fy AS INTEGER) + a.k AND q.x = CAST(fx AS INTEGER) + b.k GROUP BY ALL)"""


@query(f"WITH {PROFILES.replace('FROM c, (VALUES (0), (1)) a(k), (VALUES (0), (1)) b(k) LEFT JOIN', 'FROM c CROSS JOIN (VALUES (0), (1)) a(k) CROSS JOIN (VALUES (0), (1)) b(k) LEFT JOIN')} SELECT curve, point, i, round(v, 5) + 0 AS v FROM b")
def profile_sample(spark, sf_dir):
    found = fitting.profiles(_placed(spark, sf_dir), pixels(spark, sf_dir), ["frame", "curve", "point"], 8, 3)
    return rounded(found.select("curve", "point", F.posexplode("profile").alias("i", "v")).withColumn("i", F.col("i").cast("long")), "v", digits=5)


_PIXEL_ROWS = f"{PIXELS_SQL}, rows AS (SELECT frame, y, list(v ORDER BY x) AS profile FROM pixels GROUP BY ALL)"


@query(f"WITH {_PIXEL_ROWS} SELECT frame, y, list_max(profile) AS amp, list_position(profile, list_max(profile)) - 32.5::DOUBLE AS mean, list_min(profile) AS bg FROM rows")
def profile_guess(spark, sf_dir):
    rows = pixels(spark, sf_dir).groupBy("frame", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("profile"))
    g = fitting.first_guess(F.col("profile"), 64, 2.0)
    return rows.select("frame", "y", g[0].alias("amp"), g[1].cast("double").alias("mean"), g[3].alias("bg"))


@query()
def gaussian_fit(spark, sf_dir):
    found = fitting.fit_profiles(_placed(spark, sf_dir), pixels(spark, sf_dir), ["frame", "curve", "point"])
    return rounded(found.select("curve", "point", "x", "y", "amp", "sd", "bg", "r2", "integr"), "x", "y", "amp", "sd", "bg", "r2", "integr", digits=4)


@query(f"WITH {PIXELS_SQL} SELECT frame, y, round(regr_slope(v, x), 5) + 0 AS slope, round(regr_intercept(v, x), 5) + 0 AS intercept FROM pixels GROUP BY ALL")
def line_fit(spark, sf_dir):
    rows = pixels(spark, sf_dir).groupBy("frame", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("profile"))
    fit = fitting.fit_arrays("line", [float(i) for i in range(64)])("profile", F.array(F.lit(1.0), F.lit(1.0)))
    return rounded(rows.select("frame", "y", fit.alias("f")).select("frame", "y", F.col("f.a")[0].alias("slope"), F.col("f.a")[1].alias("intercept")), "slope", "intercept", digits=5)


_PLANE = f"""{PIXELS_SQL}, mo AS (SELECT frame, avg(v) AS v, avg(x) AS x, avg(y) AS y, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM pixels GROUP BY frame),
    sl AS (SELECT *, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS bx, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS byy FROM mo), plane AS (SELECT frame, v - bx * x - byy * y AS a, bx, byy FROM sl)"""


@query(f"WITH {_PLANE} SELECT frame, round(a, 5) + 0 AS a, round(bx, 6) + 0 AS by_x, round(byy, 6) + 0 AS by_y, n, round(chi2, 2) + 0 AS chi2 FROM plane JOIN (SELECT frame, count(*) AS n, sum((v - a - bx * x - byy * y) ** 2) AS chi2 FROM pixels JOIN plane USING (frame) GROUP BY frame) USING (frame)")
def plane_fit(spark, sf_dir):
    f = group_fits.linear_fit(pixels(spark, sf_dir), ["frame"], F.col("v"), [F.lit(1.0), F.col("x"), F.col("y")])
    f = f.select("frame", F.col("a")[0].alias("a"), F.col("a")[1].alias("by_x"), F.col("a")[2].alias("by_y"), "n", "chi2")
    return rounded(rounded(rounded(f, "a", digits=5), "by_x", "by_y"), "chi2", digits=2)


@query(f"""WITH {PIXELS_SQL}, w AS (SELECT *, 1.0::DOUBLE + x % 3 AS w FROM pixels WHERE x % 7 <> 0), mo AS (SELECT frame, y, sum(w) AS s, sum(w * x) / sum(w) AS mx, sum(w * v) / sum(w) AS mv, count(*) AS n FROM w GROUP BY ALL),
    sl AS (SELECT frame, y, any_value(n) AS n, any_value(mx) AS mx, any_value(mv) AS mv, sum(w * (x - mx) * (v - mv)) / sum(w * (x - mx) * (x - mx)) AS b FROM w JOIN mo USING (frame, y) GROUP BY frame, y)
    SELECT frame, y, round(b, 6) + 0 AS slope, round(mv - b * mx, 5) + 0 AS intercept, n FROM sl""")
def weighted_line_fit(spark, sf_dir):
    weight = F.when(F.col("x") % 7 != 0, 1.0 + F.col("x") % 3)
    f = group_fits.linear_fit(pixels(spark, sf_dir), ["frame", "y"], F.col("v"), [F.col("x"), F.lit(1.0)], weight)
    return rounded(rounded(f.select("frame", "y", F.col("a")[0].alias("slope"), F.col("a")[1].alias("intercept"), "n"), "slope"), "intercept", digits=5)


@query(f"WITH {_PLANE} SELECT frame, round(a, 3) + 0 AS a, round(bx, 4) + 0 AS by_x, round(byy, 4) + 0 AS by_y FROM plane")
def surface_fit(spark, sf_dir):
    """A model that isn't linear in its parameters, but has the plane as its best fit: v = a + a b x + c y."""
    p = pixels(spark, sf_dir)
    start = p.select("frame").distinct().withColumn("a", F.array(F.lit(1.0), F.lit(0.1), F.lit(0.0)))
    f = group_fits.nonlinear_fit(p, ["frame"], F.col("v"), lambda a: a[0] + a[0] * a[1] * F.col("x") + a[2] * F.col("y"), lambda a: [1 + a[1] * F.col("x"), a[0] * F.col("x"), F.col("y").cast("double")], start, saver(spark), least_gain=1e-11)
    return rounded(rounded(f.select("frame", F.col("a")[0].alias("a"), (F.col("a")[0] * F.col("a")[1]).alias("by_x"), F.col("a")[2].alias("by_y")), "a", digits=3), "by_x", "by_y", digits=4)


@query(f"""WITH {PIXELS_SQL}, spots AS (SELECT DISTINCT frame, y % 16 AS g, CAST(floor((y * 7 % 40) / 2.0 + 0.5) AS INTEGER) AS yy, CAST(floor(x / 3.0 + 0.5) AS INTEGER) AS xx FROM pixels),
    m AS (SELECT frame, yy AS y, xx AS x, count(*) * 2.0 AS v FROM spots GROUP BY ALL) SELECT frame, round(avg(abs(p.v - coalesce(m.v, 0))), 6) + 0 AS error FROM pixels p LEFT JOIN m USING (frame, y, x) GROUP BY frame""")
def mean_abs_error(spark, sf_dir):
    p = pixels(spark, sf_dir)
    points = p.select("frame", (F.col("y") % 16).alias("contour"), ((F.col("y") * 7 % 40) / 2).alias("y"), (F.col("x") / 3).alias("x"))
    return rounded(images.mean_absolute_error(p, images.drawn_curves(points, F.lit(2.0))), "error")


def _blur_sql(table: str, sigma: float, name: str) -> str:
    """CTEs up to `name`: frame, y, x, v of a blurred table."""
    mask = kernel_values(0, sigma)
    return f"""{name}_k(j, m) AS (VALUES {mask}), {name}_s AS (SELECT *, max(y) OVER (PARTITION BY frame) + 1 AS h, max(x) OVER (PARTITION BY frame) + 1 AS w FROM {table}),
        {name}_x AS MATERIALIZED (SELECT o.frame, o.y, o.x, k.m, {mirrored('o.y + k.j', 'o.h')} AS yy FROM {name}_s o CROSS JOIN {name}_k k),
        {name}_d AS MATERIALIZED (SELECT o.frame, o.y, o.x, sum(p.v * o.m) AS v FROM {name}_x o JOIN {table} p ON p.frame = o.frame AND p.x = o.x AND p.y = o.yy GROUP BY ALL),
        {name}_z AS MATERIALIZED (SELECT o.frame, o.y, o.x, k.m, {mirrored('o.x + k.j', 'o.w')} AS xx FROM {name}_s o CROSS JOIN {name}_k k),
        {name} AS MATERIALIZED (SELECT o.frame, o.y, o.x, sum(p.v * o.m) AS v FROM {name}_z o JOIN {name}_d p ON p.frame = o.frame AND p.y = o.y AND p.x = o.xx GROUP BY ALL)"""


FLAT = f"""{PIXELS_SQL}, {_blur_sql('pixels', 5 * images.SIGMA, 'smooth')},
    less AS MATERIALIZED (SELECT frame, y, x, floor(p.v - b.v + 0.5) AS v FROM pixels p JOIN smooth b USING (frame, y, x)),
    mode AS (SELECT frame, arg_min(v, struct_pack(n := -n, v := v)) AS m FROM (SELECT frame, v, count(*) AS n FROM less GROUP BY ALL) GROUP BY frame),
    flat AS MATERIALIZED (SELECT frame, y, x, v - m AS v FROM less JOIN mode USING (frame))"""


@query(f"WITH {FLAT} SELECT frame, y, x, v + 0 AS v FROM flat")
def flat_image(spark, sf_dir):
    return rounded(images.without_background(pixels(spark, sf_dir)), "v")


_DRAWN = f"""{FLAT}, {CURVES_SQL}, placed AS (SELECT CAST((contour * 4 + frame) % (SELECT max(frame) FROM pixels) + 1 AS INTEGER) AS frame, contour * 4 + frame AS contour, point, x % 64 AS x, y % 64 AS y FROM curves),
    ends AS (SELECT *, coalesce(lead(x0) OVER w - x0, 0) AS dx, coalesce(lead(y0) OVER w - y0, 0) AS dy FROM (SELECT frame, contour, point, CAST(floor(x + 0.5) AS BIGINT) AS x0, CAST(floor(y + 0.5) AS BIGINT) AS y0 FROM placed) WINDOW w AS (PARTITION BY frame, contour ORDER BY point)),
    ks AS (SELECT *, greatest(abs(dx), abs(dy)) AS n, unnest(range(greatest(abs(dx), abs(dy)) + 1)) AS k FROM ends),
    raster AS MATERIALIZED (SELECT DISTINCT frame, contour, CAST(y0 + coalesce(floor((2 * k * dy + n) / nullif(2 * n, 0)), 0) AS INTEGER) AS y, CAST(x0 + coalesce(floor((2 * k * dx + n) / nullif(2 * n, 0)), 0) AS INTEGER) AS x FROM ks),
    under AS MATERIALIZED (SELECT r.*, f.v FROM raster r JOIN flat f USING (frame, y, x)),
    value AS (SELECT frame, contour, avg(v) * {images.SIGMA}::DOUBLE / 0.342::DOUBLE AS value FROM under GROUP BY ALL),
    tops AS (SELECT frame, y, x, max(contour) AS contour FROM under GROUP BY ALL),
    drawn AS MATERIALIZED (SELECT f.frame, f.y, f.x, coalesce(value, 0) AS v FROM flat f LEFT JOIN (SELECT t.frame, t.y, t.x, value FROM tops t JOIN value USING (frame, contour)) d USING (frame, y, x)),
    {_blur_sql('drawn', images.SIGMA, 'model')}"""


@query(f"WITH {_DRAWN} SELECT frame, contour, y, x FROM raster")
def raster_lines(spark, sf_dir):
    return reconstruction.rasterised(_placed(spark, sf_dir).withColumnRenamed("curve", "contour"))


@query(f"WITH {_DRAWN} SELECT frame, round(avg(abs(f.v - m.v)), 6) + 0 AS error FROM flat f JOIN model m USING (frame, y, x) GROUP BY frame")
def reconstruction_error(spark, sf_dir):
    flat = saver(spark)(images.without_background(pixels(spark, sf_dir)), "flat")
    return rounded(reconstruction.reconstruction_error(_placed(spark, sf_dir).withColumnRenamed("curve", "contour"), flat), "error")


def _traced(spark, sf_dir):
    return images.classify(_ridges(spark, sf_dir), 0.25, 0.5)


@query()
def threshold_counts(spark, sf_dir):
    shown = saver(spark)(images.saliency(_ridges(spark, sf_dir)), "saliency")
    return threshold_grid(shown, [0.25, 0.5, 0.75, 1.0], [0.25, 0.5, 0.75, 1.0, 1.5], saver(spark))


@query()
def best_thresholds(spark, sf_dir):
    """Three generations of the search, from the frames' own range."""
    save = saver(spark)
    ridges, flat = save(_ridges(spark, sf_dir), "ridges"), save(images.without_background(pixels(spark, sf_dir)), "flat")
    errors = optimiser.threshold_errors(ridges, flat, save)
    (a, b), error = optimiser.simplex_search(spark, errors, (0.25, 0.5), (0.25, 0.25), generations=3)
    return spark.createDataFrame([(min(a, b), max(a, b), error)], "low double, high double, error double")


@query()
def trace_curves(spark, sf_dir):
    return rounded(tracing.trace(_traced(spark, sf_dir), extend=4.5), "x", "y", "angle", "response", digits=4)


@query()
def trace_junctions(spark, sf_dir):
    return rounded(tracing.junctions(_traced(spark, sf_dir), extend=4.5), "x", "y", digits=4)


@query()
def line_width(spark, sf_dir):
    ridges = _ridges(spark, sf_dir)
    traced = saver(spark)(tracing.trace(images.classify(ridges, 0.25, 0.5)), "traced")
    found = widths.line_widths(traced, ridges.select("frame", "y", "x", F.col("gradient").alias("v")), 4.5)
    return rounded(curves.gaps_filled(found, "width_l", "width_r"), "x", "y", "angle", "response", "width_l", "width_r", "grad_l", "grad_r", digits=4)


_EDGES = f"""{_facet_sql("gr", f"{DERIVATIVES}, gr AS MATERIALIZED (SELECT frame, y, x, sqrt(r * r + c * c) AS v FROM deriv)")},
    g1 AS (SELECT *, 2 * drr AS frr, drc AS frc, 2 * dcc AS fcc, drr + dcc AS mean, sqrt((drr - dcc) * (drr - dcc) + drc * drc) AS root FROM f),
    g2 AS (SELECT *, CASE WHEN mean > 0 THEN mean + root ELSE mean - root END AS l FROM g1),
    g3 AS (SELECT *, CASE WHEN abs(l - frr) > abs(l - fcc) THEN frc ELSE l - fcc END AS u, CASE WHEN abs(l - frr) > abs(l - fcc) THEN l - frr ELSE frc END AS v FROM g2 WHERE l < 0),
    g4 AS (SELECT *, coalesce(u / nullif(sqrt(u * u + v * v), 0), 0) AS ny, coalesce(v / nullif(sqrt(u * u + v * v), 0), 1) AS nx FROM g3),
    g5 AS (SELECT *, -(dr * ny + dc * nx) / nullif(frr * ny * ny + 2 * frc * ny * nx + fcc * nx * nx, 0) AS t FROM g4),
    edges AS MATERIALIZED (SELECT frame, y, x, y + t * ny AS ey, x + t * nx AS ex, d + t * ny * dr + t * nx * dc + t * t * (ny * ny * drr + ny * nx * drc + nx * nx * dcc) AS height FROM g5 WHERE abs(t * ny) <= 0.5 AND abs(t * nx) <= 0.5)"""


@query(f"""WITH {_EDGES}, {CURVES_SQL}, placed AS (SELECT CAST((contour * 4 + frame) % (SELECT max(frame) FROM pixels) + 1 AS INTEGER) AS frame, contour * 4 + frame AS curve, point, x % 64 AS x, y % 64 AS y, angle FROM curves),
    r0 AS (SELECT *, cos(angle) AS ny, sin(angle) AS nx, CASE WHEN cos(angle) < 0 THEN -1 ELSE 1 END AS sy, CASE WHEN sin(angle) < 0 THEN -1 ELSE 1 END AS sx FROM placed),
    r1 AS (SELECT r0.*, i.i, j.j, greatest(CASE WHEN i.i > 0 THEN (i.i - 0.5) / abs(ny) ELSE 0 END, CASE WHEN j.j > 0 THEN (j.j - 0.5) / abs(nx) ELSE 0 END) AS tin, least((i.i + 0.5) / abs(ny), (j.j + 0.5) / abs(nx)) AS tout
           FROM r0 CROSS JOIN (SELECT unnest(range(6)) AS i) i CROSS JOIN (SELECT unnest(range(6)) AS j) j),
    rays AS MATERIALIZED (SELECT frame, curve, point, x, y, ny, nx, side, tin, CAST(floor(y + 0.5) + side * sy * i AS INTEGER) AS ry, CAST(floor(x + 0.5) + side * sx * j AS INTEGER) AS rx FROM r1 CROSS JOIN (VALUES (-1), (1)) s(side) WHERE tin <= tout AND tin <= 4.5),
    met AS (SELECT r.frame, curve, point, side, arg_min(struct_pack(w := abs((ey - r.y) * ny + (ex - r.x) * nx), h := height), tin) AS e FROM rays r JOIN edges e ON e.frame = r.frame AND e.y = r.ry AND e.x = r.rx GROUP BY ALL),
    ends AS (SELECT frame, curve, point, max(CASE WHEN side = -1 THEN e.w END) AS wl, max(CASE WHEN side = 1 THEN e.w END) AS wr, max(CASE WHEN side = -1 THEN e.h END) AS gl, max(CASE WHEN side = 1 THEN e.h END) AS gr FROM met GROUP BY ALL)
    SELECT p.frame, p.curve, p.point, round(wl, 4) + 0 AS width_l, round(wr, 4) + 0 AS width_r, round(gl, 4) + 0 AS grad_l, round(gr, 4) + 0 AS grad_r FROM placed p LEFT JOIN ends USING (frame, curve, point)""")
def facet_widths(spark, sf_dir):
    gradient = saver(spark)(_ridges(spark, sf_dir).select("frame", "y", "x", F.col("gradient").alias("v")), "gradient")
    found = widths.line_widths(_placed(spark, sf_dir), gradient, 4.5, ["frame", "curve", "point"])
    return rounded(found.select("frame", "curve", "point", "width_l", "width_r", "grad_l", "grad_r"), "width_l", "width_r", "grad_l", "grad_r", digits=4)


@query()
def curve_table(spark, sf_dir):
    found = lines.curve_table(pixels(spark, sf_dir), saver(spark))
    return rounded(found, "x", "y", "angle", "response", "width_l", "width_r", "grad_l", "grad_r", "correction", "asymmetry", "contrast", digits=4)
