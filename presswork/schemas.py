"""Schemas of the stored and exchanged tables."""
from pyspark.sql import types as T

_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PAGE = _struct(page_id=_L, url=_S, html=_S)

ARTICLE = _struct(
    news_id=_S, source=_S, url=_S, title=_S, content=_S, description=_S, author=_S, published_date=_S,
    image_url=_S, ai_summary=_S, quality_score=_D, content_fingerprint=_S, extraction_strategy=_S,
    created_at=_TS, title_hash=_S, created_date=T.DateType(),
)

ARTICLE_METADATA = _struct(
    extraction_strategy=_S, quality_score=_D, confidence_score=_D, content_length=_L, scraped_at=_S,
)

# Articles as exchanged in JSON files.
FALLBACK_ARTICLE = _struct(
    news_id=_S, news_source=_S, source_url=_S, news_title=_S, news_content=_S, description=_S, author=_S,
    news_published_date=_S, image_url=_S, metadata=ARTICLE_METADATA, ai_summary=_S,
)

EXTRACTION_METRIC = _struct(
    source=_S, url=_S, strategy=_S, quality_score=_D, confidence_score=_D, content_length=T.IntegerType(),
    fallback_count=T.IntegerType(), errors=_S, created_at=_TS,
)

RUN = _struct(
    run_id=_S, articles_found=_L, new_articles=_L, duplicates=_L, errors=_L, runtime_seconds=_D, created_at=_TS,
)

STATUS = _struct(execution_id=_S, status=_S, details=_S, updated_at=_TS)

SOURCE_LOG = _struct(source=_S, ts=_TS, ok=T.BooleanType(), n_articles=T.IntegerType())

REQUEST = _struct(client_id=_S, ts=_TS)
