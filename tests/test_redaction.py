import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from portlight.functions import privacy
from portlight.operators import conversations

ALPHABET = st.text("ey.a=-_+/ \nE1", max_size=40)


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_linear_tokens_match_as_the_pattern_does(text):
    pattern = dict(privacy.SECRETS)["JWT"]
    fast, whole, group = privacy.LINEAR["JWT"]
    assert [m.span() for m in re.finditer(pattern, text)] == [m.span(group) for m in re.finditer(fast, text)]
    assert re.sub(pattern, "<JWT>", text) == re.sub(fast, r"\1<JWT>", text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["pin", "code", "password", "pass", "is", " ", "  ", "\n", ":", "-", "=", ".", "1234", "123456", "hunter22", "ab", "x"]), max_size=14).map("".join))
def test_linear_credentials_match_as_the_patterns_do(text):
    for kind, pattern in privacy.CREDENTIALS:
        assert [m.span(1) for m in re.finditer(pattern, text, re.ASCII)] == [m.span(1) for m in re.finditer(privacy.LINEAR[kind][0], text, re.ASCII)]


@pytest.mark.parametrize("text", ["ey" * 50_000, "ey" * 50_000 + ".", "ey" * 50_000 + ". x", "a." + "ey" * 50_000, "password" + " " * 30_000, "pin " + "- " * 15_000, "-----BEGIN A PRIVATE KEY-----" * 3_000])
def test_masking_is_linear(spark, text):
    rows = spark.createDataFrame([(text,)], "t string")
    rows.select(privacy.mask("t")).collect()  # compiled once
    began = time.time()
    rows.select(privacy.mask("t")).collect()
    privacy.redact_text(text, {})
    assert time.time() - began < 5


def test_many_addresses_are_redacted_in_no_time():
    text, tokens = " ".join(f"u{i}@x.org" for i in range(20_000)), {}
    began = time.time()
    hidden = privacy.redact_text(text, tokens)
    assert time.time() - began < 5 and len(tokens) == 20_000 and "@" not in hidden
    assert privacy.restore_text("[EMAIL_ADDRESS_20000]", tokens) == "u0@x.org"  # numbered from the right


def test_rules_of_the_caller(spark):
    row = spark.createDataFrame([("order A-77 of a@x.org costs $5",)], "t string").select(privacy.mask("t", rules=[(r"[A-Z]-\d+", "ARTICLE"), (r"\$\d+", "PRICE $1")]).alias("m")).first()
    assert row.m == "order <ARTICLE> of <EMAIL_ADDRESS> costs <PRICE $1>"


def test_keys_of_secrets(spark):
    assert privacy.sealing_key("AB" * 32) == "AB" * 32 and len(privacy.sealing_key("x")) == 64 != privacy.sealing_key("y")
    with pytest.raises(ValueError):
        privacy.sealing_key("")
    rows = spark.createDataFrame([("é text",), ("",), (None,)], "t string").select("t", privacy.encrypt("t", "s").alias("c"))
    assert [(r.t, r.d) for r in rows.select("t", privacy.decrypt("c", privacy.sealing_key("s")).alias("d")).collect()] == [("é text", "é text"), ("", None), (None, None)]


def test_rows_without_keys_and_repeated_rows(spark):
    rows = spark.createDataFrame(
        [(None, None, "mail a@b.com"), (None, 1, "mail a@b.com and c@d.com"), (1, None, "x@y.org"), (1, None, "x@y.org"), (1, 0, "x@y.org, z@y.org"), (1, 0, "z@y.org"), (None, None, "mail a@b.com"), (2, 0, None), (None, None, None)],
        "conv_id long, turn long, text string",
    )
    out, tokens = conversations.redact_conversations(rows)
    got = sorted((r.conv_id or 0, -1 if r.turn is None else r.turn, r.redacted or "") for r in out.collect())
    assert got == sorted([
        (0, -1, "mail [EMAIL_ADDRESS_1]"), (0, -1, "mail [EMAIL_ADDRESS_1]"), (0, -1, ""), (0, 1, "mail [EMAIL_ADDRESS_1] and [EMAIL_ADDRESS_2]"),
        (1, -1, "[EMAIL_ADDRESS_1]"), (1, -1, "[EMAIL_ADDRESS_1]"), (1, 0, "[EMAIL_ADDRESS_1], [EMAIL_ADDRESS_2]"), (1, 0, "[EMAIL_ADDRESS_2]"), (2, 0, ""),
    ])
    back = conversations.restore_conversations(out, tokens)
    key = lambda r: repr((r[0], r[1], r[2]))
    assert sorted(map(key, back.select("conv_id", "turn", "restored").collect())) == sorted(map(key, rows.collect()))


def test_rows_without_a_turn_meet_their_own_values_alone(spark):
    """Rows of one conversation without a turn number once met each other's values, so a text was rewritten for all of them."""
    from portlight.operators import conversations

    rows = spark.createDataFrame([(1, None, "pin: 4711 of a@x.org"), (1, None, "order 4711 from b@x.org"), (1, 2, None)], "conv_id long, turn long, text string")
    out, tokens = conversations.redact_conversations(rows)
    back = {r.text: (r.redacted, r.restored) for r in conversations.restore_conversations(out, tokens).collect()}
    assert all(text == restored for text, (_, restored) in back.items())
    assert back["order 4711 from b@x.org"][0].startswith("order 4711 from [EMAIL_ADDRESS_")


def test_a_value_is_not_found_in_tokens(spark):
    from portlight.operators.conversations import _replaced

    assert _replaced("ab ADDRESS ab", [("ab", "[EMAIL_ADDRESS_1]"), ("ADDRESS", "[PASSWORD_2]")]) == "[EMAIL_ADDRESS_1] [PASSWORD_2] [EMAIL_ADDRESS_1]"


def test_texts_go_to_python_in_small_batches(spark):
    from portlight.functions import privacy

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 10000)
    privacy.redact("text")
    assert int(spark.conf.get(name)) <= privacy.BATCH_ROWS
