"""Table schemas."""

from pyspark.sql import types as T

RAW_LEAD = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_rank", T.LongType(), False),
    T.StructField("company_name", T.StringType(), False),
    T.StructField("website", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("address", T.StringType()),
])

LEAD = T.StructType([
    T.StructField("lead_id", T.LongType(), False),
    T.StructField("company_name", T.StringType(), False),
    T.StructField("website", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("contact_page", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("score", T.IntegerType(), False),
    T.StructField("seq", T.LongType(), False),
])

CRAWL = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("html", T.StringType()),
])

PLACES = T.StructType([
    T.StructField("search_term", T.StringType(), False),
    T.StructField("direct_address", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("address", T.StringType()),
])

VERDICTS = T.StructType([
    T.StructField("lead_key", T.LongType(), False),
    T.StructField("answer", T.StringType()),
    T.StructField("error", T.StringType()),
])

# The eight exported columns, in order.
EXPORT_COLUMNS = [
    "company_name", "website", "email", "description",
    "contact_page", "address", "sources", "score",
]
