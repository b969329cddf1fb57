"""The event envelope and the usage fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = ("input_fresh", "output", "cache_read", "cache_write", "cache_write_5m", "cache_write_1h", "reasoning", "total")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, D, L = T.StringType(), T.DoubleType(), T.LongType()
EVENT = _struct(
    event_id=S, adapter_id=S, kind=S, schema_version=S, observed_at=T.TimestampType(), occurred_at=T.TimestampType(), origin=S, upstream_key=S,
    context=_struct(branch=S, flight_id=S, head_sha=S, repo=S, worktree=S),
    identity=_struct(commit_sha=S, generation_id=S, request_id=S, session_id=S, turn_id=S, tool_call_id=S),
    ai=_struct(tool=S, channel=S, provider=S, via=S, model=S, model_raw=S, effort=S, cwd=S, agent_id=S, parent_session_id=S, branch_source=S),
    usage=_struct(**{t: D for t in TOKENS}, request_key=S, service_tier=S, speed=S, premium_requests=D, web_search_requests=D, figure_amount=D, figure_currency=S, figure_kind=S),
    payload=S,
)
COVERAGE = _struct(adapter_id=S, path=S, state=S, rows=L, rejected=L)


def conform(df: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """``df`` with exactly the schema's columns: missing ones are null, and so are missing nested fields."""

    def field(have: T.StructType, name: str, kind: T.DataType, path: str):
        if name not in have.names:
            return F.lit(None).cast(kind)
        col = F.col(f"{path}{name}")
        if isinstance(kind, T.StructType) and isinstance(have[name].dataType, T.StructType):
            inner = have[name].dataType
            return F.when(col.isNotNull(), F.struct(*[field(inner, f.name, f.dataType, f"{path}{name}.").alias(f.name) for f in kind]))
        return col.cast(kind)

    return df.select(*[field(df.schema, f.name, f.dataType, "").alias(f.name) for f in schema])


def event_id(adapter, upstream_key, kind):
    """The id rule: a digest of adapter, upstream key and kind."""
    return F.sha2(F.concat_ws("\x00", adapter, upstream_key, kind), 256)


def upgrade(df: DataFrame) -> DataFrame:
    """Older rows read as the present version: what they lack is null, and the version says so."""
    return conform(df).withColumn("schema_version", F.lit("2"))


def empty(spark: SparkSession, schema: T.StructType = EVENT) -> DataFrame:
    return spark.createDataFrame([], schema)
