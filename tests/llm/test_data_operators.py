import hashlib
import re
import zlib
from array import array
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portlight.llm import boosting, ngram_join, packing, quality, suffix_dedup, suffixes, urls, warc

from .. import oracle


def empty(spark, schema):
    return spark.createDataFrame([], schema)


# ---- WARC ----


def test_warc_sql(spark):
    oracle.compare(spark, warc.op1_warc_salvage, warc.OP1_SQL)


@pytest.mark.parametrize("many", [warc.MANY, 1])
def test_warc_pages(spark, many, monkeypatch):
    monkeypatch.setattr(warc, "MANY", many)
    pages = [(3, "http://a", "x"), (1, None, "x"), (2, "http://b", None), (5, "u\r\nEvil: 1", ""), (7, "http://c", "WARC/1.1\r\nContent-Length: 5\r\n\r\n é"), (7, "http://c", "twice"), (7, "http://c", "twice"), (None, "n", "x"), (None, "n", "alone")]
    got = sorted(((r.page_id or 0, r.payload_bytes, r.warc_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame([(*p, 0, 0) for p in pages], "page_id long, url string, html string, payload int, n int")).collect()), key=str)
    assert got == sorted([(3, 1, "revisit", 1), (1, 1, "response", None), (2, 0, "response", None), (5, 0, "revisit", 2), (7, len(pages[4][2].encode()), "response", None), (7, 5, "response", None), (7, 5, "response", None), (0, 1, "revisit", 1), (0, 5, "response", None)], key=str)
    assert warc.archive_pages(empty(spark, "page_id long, url string, html string")).count() == 0


def records(n):
    return [warc.record_bytes(i, f"http://x/{i}", f"payload {i} ".encode() * 50) for i in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_follows_damage(packed):
    parts = [warc.gzip_member(r) if packed else r for r in records(6)]
    places = np.cumsum([0, *map(len, parts)])
    whole = b"".join(parts)
    rows = list(warc.salvage(whole))
    assert [r["page_id"] for r in rows] == list(range(6)) and all(r["kind"] == "record" for r in rows)
    broken = bytearray(whole)
    broken[places[2] + len(parts[2]) // 2] ^= 0xFF  # one flipped byte in the third
    rows = list(warc.salvage(bytes(broken)))
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == [0, 1, 3, 4, 5]
    assert [(r["start"], r["length"]) for r in rows if r["kind"] == "gap"] == [(places[2], len(parts[2]))]
    cut = whole[: places[3]] + b"\0" * 100 + whole[places[3] : -7]  # foreign bytes, and the last one cut short
    rows = list(warc.salvage(cut))
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == [0, 1, 2, 3, 4]
    assert sum(r["length"] for r in rows) == len(cut)
    assert list(warc.salvage(b"")) == [] and [r["kind"] for r in warc.salvage(b"no archive")] == ["gap"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=6), st.integers(0, 2**32), st.booleans())
def test_salvage_accounts_for_every_byte(payloads, seed, packed):
    parts = [warc.record_bytes(i, None, p) for i, p in enumerate(payloads)]
    data = bytearray(b"".join(warc.gzip_member(p) if packed else p for p in parts))
    rng = np.random.default_rng(seed)
    for _ in range(int(rng.integers(0, 3))):
        if data:
            data[int(rng.integers(len(data)))] = int(rng.integers(256))
    rows = list(warc.salvage(bytes(data)))
    assert sum(r["length"] for r in rows) == len(data) and [r["start"] for r in rows] == sorted(r["start"] for r in rows)


def test_reads_damaged_archives_through_spark(spark, tmp_path):
    parts = [warc.gzip_member(r) for r in records(3)]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"junk" + parts[1])
    (tmp_path / "b.warc").write_bytes(b"".join(records(2)) + b"WARC/1.1\r\nbroken")
    rows = warc.read_archives(spark, [f"file://{tmp_path}/a.warc.gz", f"file://{tmp_path}/b.warc"]).collect()
    assert Counter(r.kind for r in rows) == {"record": 4, "gap": 2}
    assert bytes(next(r.payload for r in rows if r.page_id == 1 and r.archive.endswith("b.warc"))) == b"payload 1 " * 50


# ---- packing ----


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 2047), max_size=300))
def test_plan_places_each_token_once(lengths):
    rows = packing.plan(np.array(lengths, dtype=np.int64))
    got = [[] for _ in lengths]
    for row in rows:
        assert 0 < sum(n for _, _, n in row) <= packing.WINDOW
        for i, start, n in row:
            assert n > 0
            got[i].append((start, n))
    for length, pieces in zip(lengths, got, strict=True):
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == length
    used = [sum(n for _, _, n in row) for row in rows]
    assert sum(packing.WINDOW - u for u in used if u & (u - 1)) <= packing.WINDOW


def test_solver_is_non_negative_and_near(spark):
    histogram = np.zeros(129, dtype=np.int64)
    histogram[[32, 64, 96]] = 100, 50, 30
    x = packing.solve_repeats(histogram)
    combos = packing.combinations(128)
    assert (x >= 0).all() and (combos.sum(1) == 128).all()
    used = sum(np.bincount(combos[:, i], weights=x, minlength=129) for i in range(3))
    assert abs(used[1:] - histogram[1:]).max() < 25


def test_pack_round_trip(spark):
    path = packing.default_tokenizer()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    docs |= {900: "", 901: None, 902: "a<|endoftext|>b", 903: "\u00a0x  y\n\n z\t" * 3000}
    frame = spark.createDataFrame([(k, v, 1) for k, v in docs.items()] + [(None, "null id", 1), (900, "", 1)], "doc_id long, text string, length int")
    rows = packing.pack_documents(frame, path).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    ids = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for k, t in docs.items()}
    seen = Counter()
    for r in rows:
        if r.doc_id is not None and r.doc_id != 900:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(array("I", part).tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
            seen.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
    assert set(seen.values()) == {1} and len(seen) == sum(len(v) for k, v in ids.items() if k != 900)
    assert sum(r.doc_id == 900 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    used = [sum(n for _, n in p) for p in sequences.values()]
    assert sum(packing.WINDOW - u for u in used if u & (u - 1)) < 0.05 * sum(used)
    assert packing.pack_documents(empty(spark, "doc_id long, text string"), path).count() == 0


# ---- quality and urls ----


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit_additive(x[:3000], y[:3000], rounds=20)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9 and (0, 1) in model.pairs
    trees = boosting.fit_trees(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    for fit in (boosting.fit_additive, boosting.fit_trees):
        one = fit(np.zeros((5, 2)), np.ones(5)).score(np.zeros((2, 2)))
        assert (one > 0.5).all() and (one <= 1).all()


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op6_additive_quality(spark, sf).toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.7)).all()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(rows[rows["held_out"]], on="doc_id")
    assert (labels["quality"] == labels["predicted"]).mean() > 0.9


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here", "a"), (2, "", "a"), (3, None, "a"), (None, " \n", "a"), (1, "fine words here", "b"), (5, "€" * 100_000, "a")], "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 0), (1, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(docs, empty(spark, "doc_id long, quality int")).count() == 6
    assert quality.classify(empty(spark, "doc_id long, text string"), labels).count() == 0
    kept = quality.keep_good(spark, spark.read.parquet(f"{oracle.SF}/documents.parquet"), oracle.SF)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def brute_judge(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls_against_brute_force(spark):
    given_ = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    given_ |= {9001: None, 9002: "", 9003: "no scheme/x", 9004: "HTTP://WWW.Example.ORG/es/x?y#z", 9005: "http://example.org/en/12", 9006: "http://x.org", 9007: "a://b.com/de/://c", 9008: "http://notorg/", 9009: "http://ÄB.com/fr/é\nx", 9010: "http://org/"}
    rows = urls.judge(spark.createDataFrame([(k, v, "h") for k, v in given_.items()], "page_id long, url string, host string")).collect()
    assert len(rows) == len(given_)
    for r in rows:
        host, path, rule, verdict = brute_judge(given_[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
        assert 0 <= r.score <= 1
    assert urls.judge(empty(spark, "page_id long, url string")).count() == 0
    assert urls.judge(spark.createDataFrame([(None, "http://x.net/a"), (None, "http://x.net/a")], "page_id long, url string")).count() == 2


def test_url_trees_learn_the_rules(spark):
    rows = urls.judge(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).filter("rule is not null").collect()
    assert sum((r.score >= 0.5) == (r.verdict == "allow") for r in rows) > 0.9 * len(rows)


@pytest.mark.parametrize("many", [2, urls.MANY])
def test_suffix_counts_hold_all_labelled_urls(spark, monkeypatch, many):
    monkeypatch.setattr(urls, "TRAIN_ROWS", 50)
    monkeypatch.setattr(urls, "MANY", many)
    seen = []
    rng = np.random.default_rng(6)
    given_ = [f"http://{'wm'[i % 2]}.s{rng.integers(40)}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['fr', 'de', 'en'])}/{i}" for i in range(1500)] + ["http://org/x", "nothing", ""]
    want = {}
    for url in given_:
        host, path, rule, verdict = brute_judge(url)
        for key in {".".join(host.split(".")[-k:]) for k in (1, 2)}:
            n = want.setdefault(key, [0, 0, 0])
            n[0] += 1
            n[1] += verdict == "allow"
            n[2] += verdict is not None
    pages = spark.createDataFrame(list(enumerate(given_)), "page_id long, url string")
    rows = urls.with_rules(pages.withColumn("host", urls.host_of(F.col("url"))).withColumn("path", urls.path_of(F.col("url"))))
    rows = urls.with_suffixes(rows).withColumn("half_", F.col("page_id") % 2).withColumn("allowed", F.col("rule_verdict_") == "allow")
    counts = urls.suffix_counts(rows)
    assert {r.suffix: [r.rows, r.allowed_0 + r.allowed_1, r.labelled_0 + r.labelled_1] for r in counts.collect()} == want
    joined = urls.with_counts(urls.with_counts(rows, counts, "top"), counts, "site").collect()
    assert len(joined) == len(given_)
    for r in joined:
        for struct, key in ((r.top, r.top_), (r.site, r.site_)):
            assert [struct.allowed_0 + struct.allowed_1, struct.labelled_0 + struct.labelled_1] == want[key][1:]
    # the model's inputs: the trees take a sample, the scores all counts
    place = urls.FEATURES.index("site_seen")
    monkeypatch.setattr(urls, "fit_trees", lambda x, y: seen.append(len(x)) or SimpleNamespace(score=lambda x: x[:, place]))
    got = {r.page_id: r.score for r in urls.judge(pages).collect()}
    assert seen[0] < 150
    assert all(abs(got[r.page_id] - np.log1p(want[r.site_][2])) < 1e-9 for r in joined)


# ---- n-gram join ----


def brute_join(docs):
    sets = {}
    for k, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def crowd():
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(300)}"
    base, docs = [word() for _ in range(150)], {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(len(w))] = word()
        docs[i] = " ".join(w[: rng.integers(143, 151)])
    for i in range(60, 90):
        docs[i] = " ".join(base[:80] + [word() for _ in range(rng.integers(3, 20))])
    for i in range(90, 120):
        docs[i] = " ".join(f"v{rng.integers(4)}" for _ in range(rng.integers(0, 7)))
    return docs | {500: None, 501: "", 502: " \n", 503: "A b C d", 504: "a B c\td", 505: "\u00c4 b", 506: "\u00e4 b", 507: "x " * 5000}


@pytest.mark.parametrize("tokens", [500, ngram_join.GROUP_TOKENS])
def test_links_against_brute_force(spark, tokens, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", tokens)
    docs = crowd()
    frame = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id long, text string, rep int")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(frame).collect()} == brute_join(docs)


def test_links_of_odd_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A B C D")]
    got = sorted(ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted(tuple(r) for r in got if r.doc_id) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)] and [tuple(r) for r in got if not r.doc_id] == [(None, 2, None)]
    assert ngram_join.link_components(empty(spark, "doc_id long, text string")).count() == 0
    kept = ngram_join.keep_representatives(spark, spark.createDataFrame([(*r, "x") for r in rows] + [(5, "", "x")], "doc_id long, text string, component_id string"), "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "None"] and kept.columns == ["doc_id", "text", "component_id"]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=120), st.integers(0, 2**32))
def test_linked_sets_share_a_segment(tokens, seed):
    rng = np.random.default_rng(seed)
    a = np.array(sorted(tokens), dtype=np.uint64)
    b = rng.permutation(a)
    drop = int(rng.integers(0, len(a) // 9 + 1))
    b = np.sort(np.concatenate([b[drop:], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 9 + 1)), dtype=np.uint64)]))
    b = np.unique(b)
    shared = len(np.intersect1d(a, b))
    if 100 * shared >= 90 * (len(a) + len(b) - shared):
        assert len(np.intersect1d(ngram_join.segment_keys(a), ngram_join.segment_keys(b)))


# ---- suffix arrays ----


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=3, max_size=60) | st.text("abcdefgé", min_size=3, max_size=40), min_size=1, max_size=8), st.integers(3, 9), st.integers(0, 9))
def test_repeated_windows_against_brute_force(texts, short, more):
    pieces, long = [t.encode() for t in texts if len(t.encode()) >= short], short + more
    if pieces:
        seen = Counter(p[i : i + n] for p in pieces for n in {short, long} for i in range(len(p) - n + 1))
        widths = [len(p) - short + 1 for p in pieces]
        want = [tuple([i + n <= len(p) and seen[p[i : i + n]] > 1 for i in range(w)] for n in (short, long)) for p, w in zip(pieces, widths, strict=True)]
        assert [tuple(list(x) for x in masks) for masks in suffixes.repeated_windows(pieces, widths, [1] * len(pieces), short, long)] == want


@settings(max_examples=100, deadline=None)
@given(st.text("ab c", min_size=40, max_size=300), st.sampled_from([0, 7, 30]))
def test_equal_windows_share_a_key(text, more):
    """However a text is cut, each window goes to one part, and equal windows to parts of one key."""
    data, short, run = text.encode(), 40, 8
    keys, seen = {}, 0
    for _, first, width, place in suffix_dedup.cut_pieces(data, short, run):
        piece = data[first : first + width + short + more - 1]
        for key, at, n, _, part in suffix_dedup.split_piece(piece, width, place, short, short + more, run):
            for i in range(n):
                assert part[i : i + short] == data[first + at + i : first + at + i + short]
                assert keys.setdefault(part[i : i + short], key) == key
                seen += 1
    assert seen == len(data) - short + 1


def test_suffix_array_is_sorted():
    text = ("banana_band" * 3 + "ananas") * 2
    t = np.frombuffer(text.encode() + b"\xff", dtype=np.uint8) + np.uint8(1)
    order = suffixes.suffix_array(t, len(t))
    assert sorted(order) == list(range(len(t)))
    assert [bytes(t[i:]) for i in order] == sorted(bytes(t[i:]) for i in range(len(t)))


def covered(texts, length):
    """For each text whether each byte is covered by a string of `length` bytes that begins elsewhere too."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        out.append((d, mask))
    return out


def brute_removed(texts, length, passage):
    runs = lambda mask: sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
    out = []
    for (d, mask), (_, short) in zip(covered(texts, length), covered(texts, passage), strict=True):
        kept = bytes(x for x, m in zip(d, mask, strict=True) if not m)
        out.append((len(d), sum(mask), runs(mask), hashlib.sha256(kept).hexdigest(), sum(short), runs(short)))
    return out


def repeating_texts():
    rng = np.random.default_rng(1)
    noise = lambda n: "".join(rng.choice(list("abcdefgh ié"), n))
    passage, line = noise(300), noise(90)
    return [noise(50) + passage + noise(40) for _ in range(12)] + [noise(30) + passage[:250], "aaaa" * 100, "ab" * 150, line * 5, noise(20) + line * 3, passage, passage, "", None, "é", noise(500)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_PIECES, 2])
@pytest.mark.parametrize("passage", [80, 50])
def test_removal_against_brute_force(spark, hot, passage, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    texts = repeating_texts()
    ids = [*range(len(texts) - 2), 3, None]
    frame = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, cover int")
    got = suffix_dedup.remove_repeats(frame, length=80, passage=passage, run=16).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *x) for i, x in zip(ids, brute_removed(texts, 80, passage), strict=True)), key=key)
    assert suffix_dedup.remove_repeats(empty(spark, "doc_id long, text string")).count() == 0


def test_removal_over_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    want = dict(zip(docs, brute_removed(docs.values(), 400, suffix_dedup.PASSAGE), strict=True))
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op10_suffix_dedup(spark, oracle.SF).collect()} == want


def test_stripped_passages_against_brute_force(spark, monkeypatch):
    """Other columns pass through whatever they are called; repeated rows repeat each other; empty texts stay."""
    monkeypatch.setattr(suffix_dedup, "PASSAGE", 80)
    monkeypatch.setattr(suffix_dedup, "RUN", 16)
    texts = repeating_texts()
    rows = [(i, t, 7, f"k{i}", None, 1.5, True) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, n_chars int, doc_key string, cover string, cover_id double, gone boolean")
    want = []
    for row, (d, mask) in zip([*rows, rows[-1]], covered([*texts, texts[-1]], 80), strict=True):
        out, whole = bytearray(), row[1] or ""
        at = 0
        for ch in whole:  # a character that is partly kept is kept whole
            size = len(ch.encode())
            if not all(mask[at : at + size]):
                out += ch.encode()
            at += size
        if row[1] is None or not any(mask) or out.decode().strip():
            text = None if row[1] is None else out.decode()
            want.append((row[0], text, None if text is None else len(text), *row[3:]))
    got = suffix_dedup.strip_repeats(spark, frame, "")
    assert got.columns == frame.columns and got.dtypes == frame.dtypes
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert len(want) < len(rows) and suffix_dedup.strip_repeats(spark, frame.limit(0), "").count() == 0


def test_kept_text_keeps_characters_whole():
    cover = [{"starts": [1], "long_spans": [0, 4]}]
    assert suffix_dedup.kept_text("éabcd", cover) == "éd"
    assert suffix_dedup.kept_text("abcdé", [{"starts": [3], "long_spans": [0, 2]}]) == "abcé"
    assert suffix_dedup.kept_text(None, None) is None


# ---- bounded samples ----


@pytest.mark.parametrize("bound", [50, 5000])
def test_sample_has_a_hard_bound(spark, bound):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id")).alias("k"), "id")
    got = [r.k for r in boosting.bounded_sample(rows, "k", bound).collect()]
    assert len(got) == len(set(got)) == min(bound, 2001)
    assert sorted(got) == sorted(r.k for r in boosting.bounded_sample(rows.repartition(3), "k", bound).collect())


def test_additive_tables_against_brute_force():
    """The vectorised score is the prior plus one entry of each table, looked up feature by feature and pair by pair."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit_additive(x, y, rounds=20, pair_rounds=30, n_pairs=3)
    new = rng.normal(size=(50, 5))
    for row, score in zip(new, model.score(new), strict=True):
        total = model.prior
        place = lambda edges, v: sum(e <= v for e in edges)
        for j, table in enumerate(model.single):
            total += table[place(model.binned.edges[j], row[j])]
        for (a, b), table in zip(model.pairs, model.double, strict=True):
            total += table[place(model.coarse.edges[a], row[a])][place(model.coarse.edges[b], row[b])]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and (0, 1) in model.pairs


def brute_features(text):
    """Some of quality.FEATURES by plain Python."""
    data, words = text.encode(), re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    if not words:
        return dict.fromkeys(quality.FEATURES, 0.0)
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = [n / len(data) for n in Counter(data).values()]
    return {
        "log_bytes": np.log(len(data)), "upper": sum(65 <= b <= 90 for b in data) / len(data), "digits": sum(48 <= b <= 57 for b in data) / len(data), "entropy": -sum(p * np.log2(p) for p in share), "log_words": np.log(len(words)),
        "word_length": np.mean([len(w) for w in words]), "distinct": len(set(low)) / len(words) ** 0.8, "repeats_last": sum(a == b for a, b in zip(low, low[1:])) / len(words), "most_common": Counter(low).most_common(1)[0][1] / len(words),
        "distinct_pairs": len(set(zip(low, low[1:]))) / max(1, len(words) - 1), "line_repeats": 1 - len(set(lines)) / len(lines), "short_words": np.mean([len(w) <= 2 for w in words]), "bars": data.count(b"|") / len(words),
    }


@settings(max_examples=100, deadline=None)
@given(st.text("aAbB1| .\n\tçé", max_size=120))
def test_quality_features_against_brute_force(text):
    got = dict(zip(quality.FEATURES, quality.features(text), strict=True))
    for name, value in brute_features(text).items():
        assert abs(got[name] - value) < 1e-9, name


def test_ranks_serve_plain_byte_level_files_alone():
    import json

    spec = json.loads(packing.tokenizer(packing.default_tokenizer()).exact.to_str())
    assert packing.ranks_serve(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}):
        assert not packing.ranks_serve(spec | change)


def test_trees_against_brute_force():
    """The vectorised margin is the prior plus the leaf that each tree, walked node by node, ends in."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0.2) & (x[:, 2] < 0.5)).astype(float)
    model = boosting.fit_trees(x, y, rounds=15)
    new = rng.normal(size=(60, 4))
    for row, margin in zip(new, model.margin(new), strict=True):
        total = model.prior
        for feature, cut, value in model.trees:
            node = 0
            for _ in range(model.depth):
                right = sum(e <= row[feature[node]] for e in model.binned.edges[feature[node]]) > cut[node]
                node = 2 * node + 1 + right
            total += value[node - (2**model.depth - 1)]
        assert abs(total - margin) < 1e-9
    assert ((model.score(x) > 0.5) == y).mean() > 0.97


def test_url_features_by_hand():
    (row,) = urls.features(["http://a-b.x.org/p1/q?k=1&m#f"], ["a-b.x.org"], ["/p1/q"], np.array([[3.0, 4.0, 1.0, 2.0]]), 0.5)
    got = dict(zip(urls.FEATURES, row, strict=True))
    url = "http://a-b.x.org/p1/q?k=1&m#f"
    share = [url.count(c) / len(url) for c in set(url)]
    want = {"length": 29, "host_length": 9, "path_length": 5, "depth": 2, "digit_ratio": 2 / 29, "entropy": -sum(p * np.log2(p) for p in share), "parameters": 2, "hyphens": 1, "labels": 3, "label_length": 3, "odd_ratio": 4 / 29, "fragment": 1, "top_rate": 5 / 8, "site_rate": 3 / 6, "site_seen": np.log(3)}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and set(want) == set(got)
