"""Weftline: curve analytics on images and large text-corpus preparation, written as Spark jobs."""
