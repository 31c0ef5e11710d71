"""Explicit schemas for everything read from or written to files."""

from pyspark.sql import types as T

# Field names and their order are the on-disk article format.
ARTICLE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("id", "url", "title", "body", "source", "publishTime", "crawledAt")
    ]
)

SITE_CONFIG = T.StructType(
    [
        T.StructField("baseUrl", T.StringType()),
        T.StructField("topicSelectors", T.ArrayType(T.StringType())),
        T.StructField("articleSelectors", T.ArrayType(T.StringType())),
        T.StructField("articleTitle", T.StringType()),
        T.StructField("articleTime", T.StringType()),
        T.StructField("articleBody", T.StringType()),
        T.StructField("maxDepth", T.IntegerType()),
    ]
)

ATTRS = T.ArrayType(
    T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
)

# One row per page holds its whole element tree. `parent` is a 0-based index into
# `els` (-1 at the root), `last` that of the last element below (itself when there is
# none); `lo`/`hi` cut an element's text out of the page text, so the text is stored
# once whatever the nesting.
ELEMENT = T.StructType(
    [
        T.StructField("parent", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", ATTRS),
        T.StructField("lo", T.IntegerType()),
        T.StructField("hi", T.IntegerType()),
    ]
)
DOM = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("els", T.ArrayType(ELEMENT))]
)

# A compiled selector: its groups, each a list of links joined by descent, each link child
# steps from the outermost element to the innermost.
PREDICATE = T.StructType(
    [
        T.StructField("attr", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
STEP = T.StructType(
    [T.StructField("tag", T.StringType()), T.StructField("preds", T.ArrayType(PREDICATE))]
)

LINKS = T.ArrayType(T.ArrayType(STEP))
SELECTOR = T.ArrayType(LINKS)

ROBOTS_RULE = T.StructType(
    [
        T.StructField("allow", T.BooleanType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("wild", T.BooleanType()),
        T.StructField("regex", T.StringType()),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Coordinates nest three deep for one geometry type and four for the other, so they
# stay JSON text until the type is known.
GEOJSON = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "geometry",
                            T.StructType(
                                [
                                    T.StructField("type", T.StringType()),
                                    T.StructField("coordinates", T.StringType()),
                                ]
                            ),
                        ),
                        T.StructField(
                            "properties",
                            T.StructType([T.StructField("name_en", T.StringType())]),
                        ),
                    ]
                )
            ),
        )
    ]
)
RING = T.ArrayType(T.ArrayType(T.DoubleType()))
POLYGON = T.ArrayType(RING)
MULTIPOLYGON = T.ArrayType(POLYGON)
