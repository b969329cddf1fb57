"""Columns over model, provider and branch names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and aliases that results must agree on.
GATEWAYS = {
    "cliproxy": "cliproxy", "openrouter": "openrouter", "github-copilot": "github-copilot", "cursor": "cursor",
    "litellm": "litellm", "requesty": "requesty", "vercel": "vercel", "copilot": "github-copilot",
    "githubcopilot": "github-copilot", "github": "github-copilot", "vercel-ai-gateway": "vercel",
}
LOCAL_RUNTIMES = {
    "ollama": "ollama", "lmstudio": "lmstudio", "llama.cpp": "llama.cpp", "vllm": "vllm", "mlx": "mlx", "local": "local",
    "lm-studio": "lmstudio", "llamacpp": "llama.cpp",
}
MAKER_PREFIXES = {
    "anthropic": "anthropic", "claude": "anthropic", "openai": "openai", "azure": "openai", "google": "google",
    "gemini": "google", "vertex": "google", "deepseek": "deepseek", "xai": "xai", "x-ai": "xai", "moonshot": "moonshot",
    "moonshotai": "moonshot", "kimi": "moonshot", "zhipu": "zhipu", "zhipuai": "zhipu", "z-ai": "zhipu", "zai": "zhipu",
    "qwen": "qwen", "alibaba": "qwen", "meta": "meta", "meta-llama": "meta", "mistral": "mistral", "mistralai": "mistral",
}
MAKER_PATTERNS = (
    ("claude|opus|sonnet|haiku", "anthropic"),
    ("^(gpt|o1|o3|o4|chatgpt|codex|davinci|text-embedding)", "openai"),
    ("gemini|gemma", "google"),
    ("deepseek", "deepseek"),
    ("grok", "xai"),
    ("kimi|moonshot", "moonshot"),
    ("glm|chatglm|zhipu", "zhipu"),
    ("qwen|qwq", "qwen"),
    ("llama", "meta"),
    ("mistral|mixtral|codestral|devstral|magistral|ministral", "mistral"),
    ("^(auto|default|composer|cursor-small|cursor-fast)", "cursor"),
)
EFFORTS = ("minimal", "none", "low", "medium", "high", "xhigh", "max", "thinking")


def segments(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(F.trim(raw)), "/"), lambda s: F.trim(s)), lambda s: s != "")


def normalize_model(raw: Column) -> Column:
    """The last path segment in lower case, without a date suffix, then without a bracketed one."""
    name = F.element_at(F.when(F.size(segments(raw)) > 0, segments(raw)), -1)
    return F.regexp_replace(F.regexp_replace(name, r"-20\d{2}-?\d{2}-?\d{2}$", ""), r"\[[^\]]*\]$", "")


def _first_of(values: Column, table: dict[str, str]) -> Column:
    """The value of the first element that is a key of the table."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.get(F.filter(F.transform(values, lambda s: F.element_at(names, s)), lambda v: v.isNotNull()), F.lit(0))


def _prefixes(raw: Column) -> Column:
    parts = segments(raw)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def infer_via(raw: Column) -> Column:
    """The gateway or local runtime that the path before the model name tells, else null."""
    return _first_of(_prefixes(raw), GATEWAYS | LOCAL_RUNTIMES)


def infer_maker(raw: Column) -> Column:
    """Who made the model: by path prefix, else by name; a local runtime's unknown model is local."""
    name = F.coalesce(normalize_model(raw), F.lit(""))
    by_name = reduce(lambda rest, pm: F.when(name.rlike(pm[0]), pm[1]).otherwise(rest), reversed(MAKER_PATTERNS), F.lit(None).cast("string"))
    local = F.when(_first_of(_prefixes(raw), LOCAL_RUNTIMES).isNotNull(), "local")
    return F.coalesce(F.when(F.trim(raw) != "", F.coalesce(_first_of(_prefixes(raw), MAKER_PREFIXES), by_name, local)), F.lit("unknown"))


def model_base(raw: Column) -> Column:
    """The name without effort and speed suffixes, however many."""
    return F.regexp_replace(normalize_model(raw), f"(-({'|'.join(EFFORTS)}|fast))+$", "")


def implied_speed(raw: Column) -> Column:
    tail = F.regexp_extract(normalize_model(raw), f"((-({'|'.join(EFFORTS)}|fast))+)$", 1)
    return F.when(tail.rlike("-fast(-|$)"), "fast")


def candidate_keys(base: Column) -> Column:
    """Price keys to try in order: as given, dotted and dashed, each also without its date."""
    undated = F.regexp_replace(base, r"-20\d{2}-?\d{2}-?\d{2}$", "")
    dashed = lambda c: F.when(c.startswith("claude-"), F.replace(c, F.lit("."), F.lit("-")))
    reordered = lambda c: F.when(c.rlike(r"^claude-\d+(-\d+)?-[a-z]+$"), F.regexp_replace(c, r"^claude-(\d+(?:-\d+)?)-([a-z]+)$", "claude-$2-$1"))
    dotted = lambda c: F.when(~c.startswith("claude-"), F.regexp_replace(c, r"(\d)-(\d)(?=-|$)", "$1.$2"))
    forms = [f(c) for c in (base, undated) for f in (lambda x: x, dashed, lambda x: reordered(dashed(x)), dotted)]
    return F.array_distinct(F.filter(F.array_compact(F.array(*forms)), lambda k: k != ""))


def branch_name(raw: Column) -> Column:
    """A branch's short name; null for blanks, HEAD, full commit ids and detached states."""
    name = F.trim(raw)
    short = F.regexp_replace(name, "^refs/heads/", "")
    bad = name.rlike(r"(?i)^[0-9a-f]{40}([0-9a-f]{24})?$") | name.rlike(r"(?i)^\(?\s*(head\s+detached|detached|no\s+branch)")
    return F.when(~bad & ~name.isin("", "HEAD") & ~short.isin("", "HEAD"), short)


def reflog_transition(subject: Column) -> Column:
    """struct(kind, from, to) of a reflog subject, null for subjects that move no HEAD."""
    checkout = r"^checkout: moving from (\S+) to (\S+)$"
    renamed = r"^Branch: renamed (?:refs/heads/)?(\S+) to (?:refs/heads/)?(\S+)$"
    returning = r"^rebase[^:]* \(finish\): returning to (\S+)$"
    started = r"^rebase[^:]* \(start\): checkout (\S+)$"
    take = lambda p, i: F.nullif(F.regexp_extract(subject, p, i), F.lit(""))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("from"), b.alias("to"))
    none = F.lit(None).cast("string")
    return (
        F.when(subject.rlike(checkout), row("checkout", take(checkout, 1), take(checkout, 2)))
        .when(subject.rlike(renamed), row("renamed", take(renamed, 1), take(renamed, 2)))
        .when(subject.rlike(returning), row("returning", none, F.regexp_replace(take(returning, 1), "^refs/heads/", "")))
        .when(subject.rlike(started), row("rebase", none, none))
    )
