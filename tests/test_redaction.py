"""Labels, flags and commands that give a secret away, and texts that must stay as they are."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text

WORD = "hunter2Fixture"
GIVEN_AWAY = (
    f"DB_PASS={WORD}", f"db.pass: {WORD}", f"passphrase={WORD}", f"OPENAI_KEY={WORD}", f"STRIPE_KEY: {WORD}", f"auth={WORD}", f"BASIC_AUTH={WORD}", f"authorization={WORD}", f"x-auth: {WORD}",
    f"app --password {WORD}", f"app --api-key '{WORD}'", f'app --client-secret "{WORD}"', f"app --db-pass {WORD}", f"app --token {WORD} --verbose", f"mysql -u root -p{WORD} db", f"mysqldump -h host -p'{WORD}' db",
    f"sshpass -p {WORD} ssh host", f"curl -u admin:{WORD} https://example.test", f"curl --user=admin:{WORD} https://example.test", f"pwd={WORD}", f"oauth: {WORD}", f'password="a\\"{WORD}"', f"app --passphrase　{WORD}", f"app --password \\\n  {WORD}",
    f"https://me:{WORD}@example.test/x", f"-----BEGIN RSA PRIVATE KEY-----\n{WORD}\n-----END RSA PRIVATE KEY-----", f"ghp_{WORD * 2}", f"sk-{WORD * 2}", f"Bearer {WORD}", f"/home/{WORD}/x",
)


@pytest.fixture(scope="module")
def redacted(spark):
    rows = spark.createDataFrame([(x,) for x in [*GIVEN_AWAY, None, "", "plain words about a passing author", "compass: north"]], "x string")
    return {r.x: r.y for r in rows.select("x", text.redact(F.col("x")).alias("y")).collect()}


@pytest.mark.parametrize("line", GIVEN_AWAY)
def test_given_away(redacted, line):
    assert WORD not in redacted[line]


def test_the_rest_of_a_line_stays(redacted):
    assert redacted[f"app --token {WORD} --verbose"] == "app --token [redacted] --verbose"
    assert redacted[f"mysql -u root -p{WORD} db"] == "mysql -u root -p[redacted] db"
    assert redacted[f"curl -u admin:{WORD} https://example.test"] == "curl -u [redacted] https://example.test"
    for clean in (None, "", "plain words about a passing author", "compass: north"):
        assert redacted[clean] == clean


def test_excerpts_are_bounded(spark):
    row = spark.range(1).select(F.create_map(F.lit("a"), F.lit("x" * 400), F.lit("b"), F.lit("y"), F.lit("c"), F.lit("no")).alias("m"))
    assert row.select(text.excerpt(F.col("m"), ("a", "b"))).first()[0] == "a=" + "x" * 120 + "; b=y"
    many = F.map_from_arrays(F.transform(F.sequence(F.lit(10), F.lit(40)), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(10), F.lit(40)), lambda i: F.repeat(F.lit("z"), F.lit(50))))
    assert len(spark.range(1).select(text.excerpt(many, tuple(str(i) for i in range(10, 41)))).first()[0]) == 512
