"""Masking of personal data and secrets in text."""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entities and their patterns, applied in this order.
ENTITIES = [
    ("CREDIT_CARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("CRYPTO", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"),
    ("DATE_TIME", r"\b(0[1-9]|1[0-2])[/-](0[1-9]|[12]\d|3[01])[/-](19|20)\d{2}\b"),
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("EMAIL_ADDRESS", r"(?<=[?&=/])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}([A-Z0-9]?){0,16}\b"),
    ("IP_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("IP_ADDRESS", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("IP_ADDRESS", r"\b(?:[0-9a-fA-F]{1,4}:){1,7}:|:(?::[0-9a-fA-F]{1,4}){1,7}\b"),
    ("PO_NUMBER", r"\b\d{8,10}(?:\/\d{1,5})?\b"),
    ("PHONE_NUMBER", r"\+1\s*\(?\d{3}\)?\s*\d{3}[-.\s]\d{4}"),
    ("PHONE_NUMBER", r"\b(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("URL", r"\bhttps?:\/\/(?:[-\w.])+(?::[0-9]+)?(?:\/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?"),
    ("CVV", r"(?i)\b(?:cvv|cvc|security\s*code|card\s*code)[\s:=]*[0-9]{3,4}\b"),
    ("BIC_SWIFT", r"(?:(?i:swift)|(?i:bic)|(?i:bank[\s-]?code)|(?i:swift[\s-]?code)|(?i:bic[\s-]?code))[:\s=]+([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"),
    ("US_BANK_NUMBER", r"\b\d{8,17}\b"),
    ("US_DRIVER_LICENSE", r"\b[A-Z]\d{7}\b"),
    ("US_ITIN", r"\b9\d{2}-\d{2}-\d{4}\b"),
    ("US_PASSPORT", r"\b[A-Z]\d{8}\b"),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b"),
    ("UK_NHS", r"\b\d{3} \d{3} \d{4}\b"),
    ("UK_NINO", r"\b[A-Z]{2}\d{6}[A-Z]\b"),
    ("ES_NIF", r"\b\d{8}[A-Z]\b"),
    ("ES_NIE", r"\b[XYZ]\d{7}[A-Z]\b"),
    ("IT_FISCAL_CODE", r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b"),
    ("IT_DOCUMENT", r"\b[A-Z]{2}\d{7}\b"),
    ("IT_VAT_CODE", r"\bIT\d{11}\b"),
    ("PL_PESEL", r"\b\d{11}\b"),
    ("FI_PERSONAL_IDENTITY_CODE", r"\b\d{6}[+-A]\d{3}[A-Z0-9]\b"),
    ("SG_NRIC_FIN", r"\b[A-Z]\d{7}[A-Z]\b"),
    ("SG_UEN", r"\b\d{8}[A-Z]\b|\b\d{9}[A-Z]\b"),
    ("AU_ABN", r"\b\d{2} \d{3} \d{3} \d{3}\b"),
    ("AU_ACN", r"\b\d{3} \d{3} \d{3}\b"),
    ("AU_TFN", r"\b\d{9}\b"),
    ("AU_MEDICARE", r"\b\d{4} \d{5} \d{1}\b"),
    ("IN_PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("IN_AADHAAR", r"\b\d{4} \d{4} \d{4}\b"),
    ("IN_VEHICLE_REGISTRATION", r"\b[A-Z]{2}\d{2}[A-Z]{2}\d{4}\b"),
    ("IN_VOTER", r"\b[A-Z]{3}\d{7}\b"),
    ("IN_PASSPORT", r"\b[A-Z]\d{7}\b"),
    ("KR_RRN", r"\b\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])-[1-4]\d{6}\b"),
]
#: Secrets and credentials. Their patterns decide which texts are hidden, so they have to be these.
SECRETS = [
    ("JWT", r"ey[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]*"),
    ("AWS_ACCESS_KEY", r"(?:AKIA|AGPA|AIDA|AROA|AIPA)[A-Z0-9]{16}"),
    ("PRIVATE_KEY", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----[\s\S]+?-----END [A-Z ]+ PRIVATE KEY-----"),
    ("AUTH_HEADER", r"(?i)(?:bearer|basic)\s+[a-zA-Z0-9\-._~+/]+=*"),
]
CREDENTIALS = [
    ("PIN", r"(?i)\b(?:pin|code|atm|passcode|passphrase|key)\b(?:\s+[a-zA-Z]{2,}){0,2}\s*[:\-=\s]*\b([0-9]{4,6})\b"),
    ("PASSWORD", r"(?i)\b(?:password|pwd|pass)\b(?:\s+(?:is|for|are|was|code|word))?[\s:\-=.]*\s*([^\s]{4,32})"),
]
#: Order numbers are business data: redact_text() leaves them, also where a later pattern would match.
KEPT = {"PO_NUMBER"}


#: The same matches in linear time, where a pattern as it stands reads a long run anew from each of its places: (pattern, group of
#: the match, group of what is hidden). A run that no full stop follows is left at once; white space is taken by one class alone.
LINEAR = {
    "JWT": (r"(?<![A-Za-z0-9\-_=])(?=[A-Za-z0-9\-_=]++\.[A-Za-z0-9\-_=])([A-Za-z0-9\-_=]*?)(ey[A-Za-z0-9\-_=]++\.[A-Za-z0-9\-_=]++\.?[A-Za-z0-9\-_.+/=]*)", 2, 2),
    "PRIVATE_KEY": (r"(?=-----BEGIN [A-Z ]+ PRIVATE KEY-----)(-----BEGIN [A-Z ]+ PRIVATE KEY-----[\s\S]+?-----END [A-Z ]+ PRIVATE KEY-----)", 1, 1),
    "PIN": (r"(?i)\b(?:pin|code|atm|passcode|passphrase|key)\b(?:\s+[a-zA-Z]{2,}){0,2}[:\-=\s]*\b([0-9]{4,6})\b", 0, 1),
    "PASSWORD": (r"(?i)\b(?:password|pwd|pass)\b(?:\s+(?:is|for|are|was|code|word))?[\s:\-=.]*([^\s]{4,32})", 0, 1),
}

#: What a text must hold for a pattern to match; a test that fails spares the patterns behind it.
GUARDS = {
    "at": lambda t: F.contains(t, F.lit("@")), "colon": lambda t: F.contains(t, F.lit(":")), "http": lambda t: F.contains(t, F.lit("http")), "digits": lambda t: t.rlike("[0-9]{3}"), "dotted": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "base58": lambda t: t.rlike("[13][a-km-zA-HJ-NP-Z1-9]{25}"), "bank": lambda t: t.rlike("[:=\\s][A-Z]{6}"), "dashes": lambda t: F.contains(t, F.lit("-----BEGIN")) & F.contains(t, F.lit(" PRIVATE KEY-----")) & F.contains(t, F.lit("-----END")), "scheme": lambda t: t.rlike("(?i)bearer|basic"),
    "ey": lambda t: F.contains(t, F.lit("ey")), "A": lambda t: t.rlike("A[KGIR][IPDO]A"),
}
NEEDS = {"CRYPTO": "base58", "EMAIL_ADDRESS": "at", "URL": "http", "BIC_SWIFT": "bank", "JWT": "ey", "AWS_ACCESS_KEY": "A", "PRIVATE_KEY": "dashes", "AUTH_HEADER": "scheme"}
#: Characters without width, which would break a number up.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"


#: Whole texts that go to Python at once, at most; they stand in a worker's memory with their copies.
BATCH_ROWS = 500


def small_batches() -> None:
    """Lets the session send whole texts to Python in batches of BATCH_ROWS at most; as it stands, its plans take 10,000 rows."""
    spark, name = SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _need(name: str, pattern: str) -> str:
    return NEEDS.get(name) or ("dotted" if pattern.startswith(r"\b(?:[0-9]{1,3}\.)") else "colon" if name == "IP_ADDRESS" else "digits")


def plain_text(text) -> Column:
    """Compatibility forms (NFKC) in place of full-width digits, ligatures and the like, and no characters without width. Only
    texts that aren't ASCII alone go through Python."""

    def run(texts: pd.Series) -> pd.Series:
        drop = dict.fromkeys(map(ord, ZERO_WIDTH))
        return texts.map(lambda x: x if not isinstance(x, str) or x.isascii() else unicodedata.normalize("NFKC", x).translate(drop))

    small_batches()
    t = F.col(text) if isinstance(text, str) else text
    plain = F.length(t) == F.octet_length(t)
    return F.when(plain, t).otherwise(F.pandas_udf(run, "string")(F.when(~plain, t)))


def _with(f, *more):
    return lambda x: f(x, *more)


def mask(text, entities=ENTITIES, rules: list[tuple[str, str]] = ()) -> Column:
    """Text in its plain form with each match of an entity as <ENTITY>, in order, secrets last, and then each match of the
    caller's rules (pattern, name) as <name>. Patterns with one need in a row are tried together, on texts that have it."""
    steps: list[tuple[str, list]] = []
    for name, pattern in [*entities, *SECRETS]:
        need = _need(name, pattern)
        if not steps or steps[-1][0] != need:
            steps.append((need, []))
        steps[-1][1].append((name, pattern))
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  the value is computed once
    needs = sorted({need for need, _ in steps})

    def replaced(x, needed, patterns):
        done = x
        for name, pattern in patterns:
            fast, whole, _ = LINEAR.get(name, (pattern, 0, 0))
            done = F.regexp_replace(done, fast, (f"$1<{name}>" if whole == 2 else f"<{name}>"))
        return F.when(needed, done).otherwise(x)

    def masked(row):
        out = row["text"]
        for need, patterns in steps:
            out = bind(out, _with(replaced, row[need], patterns))
        for pattern, name in rules:
            out = F.regexp_replace(out, pattern, "<" + name.replace("\\", "\\\\").replace("$", "\\$") + ">")
        return out

    return bind(plain_text(text), lambda t: bind(F.struct(t.alias("text"), *[GUARDS[n](t).alias(n) for n in needs]), masked))


def entity_counts(text, entities=ENTITIES) -> list[Column]:
    """Matches of each entity in a text as it stands."""
    by = {}
    for name, pattern in entities:
        by[name] = by.get(name, F.lit(0)) + F.regexp_count(text, F.lit(pattern))
    return [c.cast("long").alias(name.lower()) for name, c in by.items()]


def with_places(text: str) -> tuple[str, range | list[int]]:
    """The plain form of a text, character by character, and where in the text each of its characters stands."""
    if text.isascii():
        return text, range(len(text))
    forms = [(i, y) for i, x in enumerate(text) if x not in ZERO_WIDTH for y in unicodedata.normalize("NFKC", x)]
    return "".join(y for _, y in forms), [i for i, _ in forms]


def redact_text(text: str | None, tokens: dict[str, str]) -> str | None:
    """Replaces credentials, secrets and entities by [TYPE_n] and notes token to value in tokens; a value that has a token
    keeps it. Numbers go on after those in tokens."""
    if not text:
        return text
    values = {v: k for k, v in tokens.items()}
    number = max([int(m[1]) for k in tokens if (m := re.search(r"_(\d+)\]$", k))], default=0)

    def token(kind: str, value: str) -> str:
        nonlocal number
        if value not in values:
            number += 1
            values[value] = f"[{kind}_{number}]"
            tokens[values[value]] = value
        return values[value]

    starts: list[int] = []  # of what is taken, in order
    taken: list[tuple[int, int, str]] = []
    plain, places = with_places(text)
    for kind, pattern, group in [*[(k, p, 1) for k, p in CREDENTIALS], *[(k, p, 0) for k, p in [*SECRETS, *ENTITIES]]]:
        if kind == "PRIVATE_KEY" and "-----END" not in plain:
            continue
        fast, _, group = LINEAR.get(kind, (pattern, 0, group))
        for m in re.finditer(fast, plain, re.ASCII):
            a, b = m.span(group)
            if a < b:
                a, b = places[a], places[b - 1] + 1
            at = bisect.bisect_right(starts, a)
            free = (not at or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0])
            if a < b and free and not re.search(r"\[[A-Z_]+_\d+\]", text[a:b]):
                starts.insert(at, a)
                taken.insert(at, (a, b, kind))
    out, end = [], len(text)
    for a, b, kind in reversed(taken):  # tokens are numbered from the right
        if kind not in KEPT:
            out += [text[b:end], token(kind, text[a:b])]
            end = a
    return "".join([text[:end], *reversed(out)])


def restore_text(text: str | None, tokens: dict[str, str]) -> str | None:
    for k, v in (tokens or {}).items():
        text = text.replace(k, v) if text else text
    return text


REDACTED = T.StructType([T.StructField("redacted", T.StringType()), T.StructField("tokens", T.MapType(T.StringType(), T.StringType()))])


def _redact(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for x in texts:
        tokens: dict[str, str] = {}
        rows.append((redact_text(x, tokens) if isinstance(x, str) else None, tokens))
    return pd.DataFrame({"redacted": pd.Series([r for r, _ in rows], dtype=object), "tokens": pd.Series([t for _, t in rows], dtype=object)})


def redact(text) -> Column:
    """struct(redacted, tokens): text with tokens for personal data, and the tokens' values."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return _redact(texts)

    small_batches()
    return F.pandas_udf(run, REDACTED)(F.col(text) if isinstance(text, str) else text)


def restore(redacted, tokens) -> Column:
    """Tokens back to their values."""
    pairs = F.map_entries(tokens)
    return F.aggregate(pairs, F.col(redacted) if isinstance(redacted, str) else redacted, lambda t, e: F.replace(t, e["key"], e["value"]))


def sealing_key(secret: str) -> str:
    """The key of a secret in hex: 64 hex digits are the key itself, any other text is hashed."""
    if not secret:
        raise ValueError("a secret is needed")
    return secret if re.fullmatch(r"[0-9a-fA-F]{64}", secret) else hashlib.sha256(secret.encode()).hexdigest()


def encrypt(text, secret: str) -> Column:
    """AES-GCM as base64 iv:tag:ciphertext; null and empty texts are null."""
    t = F.col(text) if isinstance(text, str) else text
    raw = F.aes_encrypt(F.when(t != "", t), F.unhex(F.lit(sealing_key(secret))), F.lit("GCM"))
    n = F.octet_length(raw)
    part = lambda a, k: F.base64(F.substring(raw, a, k))
    return F.concat_ws(":", part(F.lit(1), F.lit(12)), part(n - 15, F.lit(16)), part(F.lit(13), n - 28))


def decrypt(text, secret: str) -> Column:
    """The text, or null where key or text are wrong."""
    p = F.split(F.col(text) if isinstance(text, str) else text, ":")
    piece = lambda i: F.unbase64(F.get(p, F.lit(i)))
    return F.try_aes_decrypt(F.concat(piece(0), piece(2), piece(1)), F.unhex(F.lit(sealing_key(secret))), F.lit("GCM")).cast("string")


def redact_json(text: str | None, tokens: dict[str, str], change=redact_text) -> str | None:
    """JSON whose texts at any depth are redacted, keys and other values as they are; what is no JSON is one text."""

    def walk(x):
        if isinstance(x, str):
            return change(x, tokens)
        if isinstance(x, list):
            return [walk(y) for y in x]
        return {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else x

    try:
        return None if text is None else json.dumps(walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return change(text, tokens)


def redact_deep(text) -> Column:
    """struct(redacted, tokens) of a JSON column: its texts with tokens, and the tokens' values."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            tokens: dict[str, str] = {}
            rows.append((redact_json(x if isinstance(x, str) else None, tokens), tokens))
        return pd.DataFrame({"redacted": pd.Series([r for r, _ in rows], dtype=object), "tokens": pd.Series([t for _, t in rows], dtype=object)})

    small_batches()
    return F.pandas_udf(run, REDACTED)(F.col(text) if isinstance(text, str) else text)


#: What a prompt says in place of a supplier's fields, and values that hide nothing.
SURROGATES = {"supplier_email": "ap@redwood-trading.example", "supplier_address": "17 Larkspur Avenue"}
NOTHING = ("N/A", "NO_DATA_FOUND")


def is_maskable(c) -> Column:
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce((t != "") & ~t.isin(*NOTHING), F.lit(False))


def with_surrogates(rows: DataFrame, fields: dict[str, str] = SURROGATES) -> DataFrame:
    """rows with surrogates in place of the fields, and their values in a map, surrogate to value."""
    pairs = F.filter(F.array(*[F.when(is_maskable(c), F.struct(F.lit(s).alias("k"), F.col(c).alias("v"))) for c, s in fields.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("surrogates", F.map_from_entries(pairs))
    return rows.withColumns({c: F.when(is_maskable(c), s).otherwise(F.col(c)) for c, s in fields.items()})


def leaks(text, surrogates) -> Column:
    """How many of the hidden values a text still holds; a prompt may go out only with none."""
    values = F.map_values(F.col(surrogates) if isinstance(surrogates, str) else surrogates)
    return F.coalesce(F.size(F.filter(values, lambda v: F.contains(F.col(text) if isinstance(text, str) else text, v))), F.lit(0))


def without_surrogates(text, surrogates) -> Column:
    """Surrogates back to their values, the longest first, whatever their case."""
    pairs = F.array_sort(F.transform(F.map_entries(F.col(surrogates)), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    quoted = lambda k: F.concat(F.lit("(?i)\\Q"), k, F.lit("\\E"))
    literal = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.aggregate(pairs, F.col(text) if isinstance(text, str) else text, lambda t, e: F.regexp_replace(t, quoted(e["k"]), literal(e["v"])))
