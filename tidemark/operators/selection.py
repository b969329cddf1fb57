"""Which rows a question is about: selectors, scopes, coverage and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(x: Column) -> Column:
    """Null for blank text."""
    return F.when(F.trim(x) != "", x)


def snapshot(events: DataFrame, equal: dict[str, str | None], since=None, until=None, occurred: str = "occurred_at", observed: str = "observed_at") -> DataFrame:
    """Events of a selector: equal columns (None: any) and a closed range of the time they happened, else were seen."""
    at = F.coalesce(occurred, observed)
    out = events
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    if since is not None:
        out = out.where(at >= F.lit(since))
    if until is not None:
        out = out.where(at <= F.lit(until))
    return out


def usage_bearing(kind: Column, usage: Column) -> Column:
    return F.coalesce(kind.startswith("ai.") & (kind != "ai.session"), F.lit(False)) & usage.isNotNull()


def account_bucket(scope: Column, request: Column, generation: Column, key: Column, channel: Column, session: Column) -> Column:
    """Whether a row is an account's bucket: said so, or without any key and either of no tool or of the usage API without a session."""
    keyless = F.coalesce(present(request), present(generation), present(key)).isNull()
    of_api = F.coalesce(channel == "usage-api", F.lit(False)) & present(session).isNull()
    return F.coalesce(scope == "provider-bucket", F.lit(False)) | (keyless & (channel.isNull() | of_api))


def unkeyed_account_row(scope: Column, request: Column, generation: Column, key: Column, channel: Column, session: Column, split: Column) -> Column:
    bucket = account_bucket(scope, request, generation, key, channel, session)
    return F.coalesce(channel == "usage-api", F.lit(False)) & present(session).isNotNull() & F.coalesce(present(request), present(generation)).isNull() & ~bucket & split.isNull()


def chat_scope(branch: Column, at: Column, wanted: str | None, since: str | None) -> Column:
    """An event without a branch is in every branch's scope; instants compare as the text they are."""
    out = F.lit(True) if wanted is None else branch.isNull() | (branch == wanted)
    return out if since is None else out & F.coalesce(at >= since, F.lit(False))


def in_basis(events: DataFrame, scope: dict[str, list[str] | None]) -> DataFrame:
    """Events of a retained basis: each listed dimension must hold one of its values; None asks for nothing."""
    out = events
    for column, values in scope.items():
        if values is not None:
            out = out.where(F.col(column).isin(values))
    return out


def latest_coverage(coverage: DataFrame, wanted: dict[str, str], adapter: str, seq: str) -> DataFrame:
    """The last coverage row of each adapter whose scope contains the selector; a null scope contains all."""
    fits = coverage
    for column, value in wanted.items():
        fits = fits.where(F.col(column).isNull() | F.array_contains(column, value))
    return fits.withColumn("__n", F.row_number().over(Window.partitionBy(adapter).orderBy(F.desc(seq)))).where("__n = 1").drop("__n")


def content_digest(*columns: str) -> Column:
    """A digest of columns by name: JSON with keys in order, nulls written out."""
    entries = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *entries), F.lit("}")), 256)


def compare_bases(before: DataFrame, after: DataFrame, ref: str, digest: str) -> DataFrame:
    """(ref, change): added, removed or changed inputs between two bases; equal ones are left out."""
    a = before.select(F.col(ref).alias("__ra"), F.col(digest).alias("__da"))
    b = after.select(F.col(ref).alias("__rb"), F.col(digest).alias("__db"))
    change = F.when(F.col("__ra").isNull(), "added").when(F.col("__rb").isNull(), "removed").when(~F.col("__da").eqNullSafe(F.col("__db")), "changed")
    return a.join(b, F.col("__ra") == F.col("__rb"), "full").select(F.coalesce("__ra", "__rb").alias(ref), change.alias("change")).where("change is not null")


def applicability(records: DataFrame, repo: str, worktree: str | None, tags: dict[str, str]) -> DataFrame:
    """Records that fit a context, with ``score``: 100 for its repository, 10 for its worktree, 1 for each other match.

    A record that names another repository, worktree or value does not fit; one that names none does.
    """
    def fits(column: str, value: str | None) -> Column:
        return F.col(column).isNull() | (F.col(column) == value if value is not None else F.lit(False))

    ok = fits("repo", repo) & fits("worktree", worktree)
    score = F.when(F.col("repo").isNotNull(), 100).otherwise(0) + F.when(F.col("worktree").isNotNull(), 10).otherwise(0)
    for column, value in tags.items():
        ok = ok & fits(column, value)
        score = score + F.when(F.col(column).isNotNull(), 1).otherwise(0)
    return records.where(ok).withColumn("score", score)


def recorded_effort(payload: Column, stored: Column, suffix: Column) -> Column:
    """The effort of a request: what its payload says, else its own field, else the model name's suffix; lower case, blank is unknown."""
    return F.lower(F.coalesce(present(payload), present(stored), present(suffix)))
