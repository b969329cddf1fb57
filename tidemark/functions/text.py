"""Columns over paths, commands, payloads and free text."""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of the patterns below.
_VALUE = r"(?:\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[^\s&]+)"
_GAP = r"(?:[^\S\r\n]|[  - 　]|\\\r?\n)+"
_LABEL = r"secret|passw(?:or)?d|passphrase|pwd|oauth|authorization|(?<![a-z])(?:pass|auth)(?![a-z])"
# What is redacted, in this order, and in small letters what a text must hold for a pattern to be tried.
SECRET_PATTERNS = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)", "[redacted:private-key]", ("-----begin",)),
    (r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", "[redacted:jwt]", ("eyj",)),
    (r"\bgithub_pat_\w{20,}", "[redacted:token]", ("github_pat_",)),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}", "[redacted:token]", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    (r"\bsk-[\w-]{16,}", "[redacted:token]", ("sk-",)),
    (r"\bxox[abprs]-[\w-]{10,}", "[redacted:token]", ("xox",)),
    (r"\bAKIA[0-9A-Z]{16}\b", "[redacted:aws-key]", ("akia",)),
    (r"\bAIza[\w-]{35}(?![\w-])", "[redacted:token]", ("aiza",)),
    (r"(?i)(?<![\w-])(?:Bearer|Basic|token)\s+[\w.~+/=-]{8,}", "[redacted:credential]", ("bearer", "basic", "token")),
    (rf"(?i)((?:{_LABEL}|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|token(?![a-z]))[\w.-]{{0,64}}[\"']?\s*[:=]=*>?\s*){_VALUE}", "$1[redacted]", ("secret", "pass", "pwd", "auth", "key", "credential", "token")),
    (rf"((?<![\w.-])[A-Z][0-9A-Z]*(?:_[0-9A-Z]+)*_(?:KEY|PAT)[\"']?\s*[:=]=*>?\s*){_VALUE}", "$1[redacted]", ("_key", "_pat")),
    (rf"(?i)((?<![\w-])--?[\w.-]{{0,64}}?(?:{_LABEL}|token|api[_-]?key){_GAP})(?!-)(?:\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[^\s&;|]+)", "$1[redacted]", ("secret", "pass", "pwd", "auth", "token", "key")),
    (rf"(\b(?:mysql\w*|mariadb\w*|sshpass)\b[^\n|;&]{{0,512}}?\s)(-p(?:{_GAP})?)(?!-)[^\s&;|]+", "$1$2[redacted]", ("mysql", "mariadb", "sshpass")),
    (r"(\bcurl\b[^\n|;&]{0,512}?\s)((?:-[Uu]|--(?:proxy-)?user)(?:\s+|=)?)(?!-)[^\s&;|]+", "$1$2[redacted]", ("curl",)),
    (r"(?i)\b([a-z][\d+.a-z-]{0,31}://)[^\s/@]+@", "$1[redacted]@", ("://",)),
    (r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+\b", "[redacted:email]", ("@",)),
    (r"(?:/Users|/home)/[^/\s\"']+", "~", ("/users/", "/home/")),
    (r"[A-Za-z]:\\Users\\[^\\\s\"']+", "~", (":\\users\\",)),
)
# What a key-like run is, and the bounds of an excerpt.
MIN_KEY_ENTROPY = 4.3
MAX_KEY_SLASHES = 2
MAX_KEY_WORD_SHARE = 0.7
MAX_VALUE_CHARS = 120
MAX_EXCERPT_CHARS = 512


def normalize_path(path: Column) -> Column:
    return F.when(path.rlike("^/+$"), "/").otherwise(F.regexp_replace(path, "/+$", ""))


def absolute_path(path: Column) -> Column:
    """A path with forward slashes, a capital drive letter and no empty, ``.`` or ``..`` parts; null if it is not absolute."""
    slashed = F.translate(F.trim(path), "\\", "/")
    drive = F.upper(F.regexp_extract(slashed, "^([A-Za-z]:)/", 1))
    rest = F.regexp_replace(slashed, "^[A-Za-z]:(?=/)", "")
    step = lambda seen, s: F.when(s.isin("", "."), seen).when(s == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(s)))
    parts = F.aggregate(F.split(rest, "/"), F.array().cast("array<string>"), step)
    return F.when(rest.startswith("/"), F.concat(drive, F.lit("/"), F.array_join(parts, "/")))


def path_prefixes(path: Column) -> Column:
    """An absolute path and all folders above it, the root first."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    upto = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.concat(upto(n), F.lit("/"))).otherwise(upto(n)))


def is_contained(path: Column, root: Column) -> Column:
    p, r = normalize_path(path), normalize_path(root)
    return (p == r) | (r == "/") | F.startswith(p, F.concat(r, F.lit("/")))


def join_path(base: Column, path: Column) -> Column:
    return normalize_path(F.when(path.startswith("/"), path).otherwise(F.concat(normalize_path(base), F.lit("/"), F.regexp_replace(path, r"^(\./)+", ""))))


def command_paths(command: Column, cwd: Column) -> Column:
    """Folders a shell command touches: each ``cd``, ``pushd`` or ``git -C`` moves on from the one before."""
    steps = F.split(command, r"\s*(?:&&|\|\||;|\|)\s*")
    target = lambda s: F.nullif(F.regexp_extract(s, r"^(?:cd|pushd|git\s+-C)\s+[\"']?([^\s\"']+)", 1), F.lit(""))
    step = lambda seen, s: F.when(target(s).isNotNull(), F.concat(seen, F.array(join_path(F.element_at(seen, -1), target(s))))).otherwise(seen)
    return F.aggregate(steps, F.array(normalize_path(cwd)), step, lambda seen: F.array_distinct(F.slice(seen, 2, F.size(seen))))


def entropy_bits(text: Column) -> Column:
    """Shannon entropy of the characters of a text, in bits a character."""
    chars = F.split(text, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.length(text))
    return F.when(F.length(text) > 0, -F.aggregate(counts, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


#: Each letter and digit stands for its class.
_CLASSES = ascii_lowercase + ascii_uppercase + digits, "a" * 26 + "A" * 26 + "0" * 10


def looks_like_key(run: Column) -> Column:
    """Long runs with digits and both cases, few slashes, few word-like stretches and high entropy.

    The run is drawn once with a letter for each class; what a pattern takes out of that
    drawing is its share of the run.
    """
    drawn = F.translate(run, *_CLASSES)
    taken = lambda pattern: F.length(run) - F.length(F.regexp_replace(drawn, pattern, ""))
    of_each_class = F.forall(F.array(*[taken(c) for c in "aA0"]), lambda n: n > 1)
    in_words = taken("A?a{3,}")
    return of_each_class & (taken("/") <= MAX_KEY_SLASHES) & (in_words < F.length(run) * MAX_KEY_WORD_SHARE) & (entropy_bits(run) >= MIN_KEY_ENTROPY)


def redact(text: Column) -> Column:
    """The text with secrets, mail addresses and home folders replaced, then key-like runs.

    Patterns are tried only on texts that hold one of their hints, so a clean text costs one
    search for each group of hints and one pass for the runs.
    """
    out = text
    for patterns in (SECRET_PATTERNS[:8], SECRET_PATTERNS[8:14], SECRET_PATTERNS[14:]):
        hints = sorted({hint for *_, every in patterns for hint in every})
        some = text.rlike("(?i)" + "|".join(map(re.escape, hints)))
        tried = out
        for pattern, replacement, _ in patterns:
            tried = F.regexp_replace(tried, pattern, replacement)
        out = F.when(some, tried).otherwise(out)
    # A plain search for a run first: the rest would take the text apart twice.
    has_run = text.rlike("(?<![0-9+/A-Za-z])[0-9+/A-Za-z]{40}")
    return F.when(has_run, _without_keys(out)).otherwise(out)


def _without_keys(text: Column) -> Column:
    runs = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("((?<![0-9+/A-Za-z])[0-9+/A-Za-z]{40,}+={0,2})"), F.lit(1))), looks_like_key)
    return F.aggregate(runs, text, lambda t, run: F.replace(t, run, F.lit("[redacted:secret]")))


def excerpt(payload: Column, allow: tuple[str, ...], max_fields: int = 24, max_chars: int = MAX_VALUE_CHARS, max_total: int = MAX_EXCERPT_CHARS) -> Column:
    """A bounded excerpt of a string map: allowed keys in order, each value redacted and cut, and the whole cut as well."""
    entries = F.filter(F.array_sort(F.map_entries(payload)), lambda e: e["key"].isin(*allow))
    lines = F.transform(F.slice(entries, 1, max_fields), lambda e: F.concat(e["key"], F.lit("="), F.substring(redact(e["value"]), 1, max_chars)))
    return F.substring(F.array_join(lines, "; "), 1, max_total)


def summary(payload: Column, limit: int = 6) -> Column:
    """The first sorted numeric or boolean fields of a string map."""
    plain = F.filter(F.array_sort(F.map_entries(payload)), lambda e: e["value"].rlike(r"^(-?\d+(\.\d+)?|true|false)$"))
    return F.array_join(F.transform(F.slice(plain, 1, limit), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def outcome(status: Column, failed: Column, errors: Column, second: Column) -> Column:
    """passed, failed or unknown: failing counts first, then the status words, then zero counts."""
    word = lambda c: F.when(F.lower(F.trim(c)).isin("failed", "fail", "failure", "error", "errored"), "failed").when(F.lower(F.trim(c)).isin("passed", "pass", "success", "ok", "succeeded"), "passed")
    return F.coalesce(
        F.when(F.coalesce(failed, F.lit(0)) + F.coalesce(errors, F.lit(0)) > 0, "failed"), word(status), word(second),
        F.when((failed == 0) & (errors == 0), "passed"), F.lit("unknown"),
    )


def command_failed(exit_code: Column, spawn_error: Column) -> Column:
    return F.coalesce(exit_code != 0, F.nullif(F.trim(spawn_error), F.lit("")).isNotNull())


def human_count(n: Column) -> Column:
    return F.when(F.abs(n) >= 1e9, F.format_string("%.1fB", n / 1e9)).when(F.abs(n) >= 1e6, F.format_string("%.1fM", n / 1e6)).when(F.abs(n) >= 1e3, F.format_string("%.1fk", n / 1e3)).otherwise(F.format_string("%.0f", n.cast("double")))


def human_duration(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.when(s >= 3600, F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
