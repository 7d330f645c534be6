import hashlib
import re
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from portlight.llm import infill, packing, repair, token_files

from .. import oracle

LONG = 1_000_000
RUNS = [" " * LONG, "\n" * LONG, "\t" * LONG, (" \n\t\r" * LONG)[:LONG], "　" * 300_000, "a" * LONG, "." * LONG]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


# ---- ids of texts with long runs ----


@pytest.mark.parametrize("run", RUNS, ids=lambda x: repr(x[:2]))
def test_long_runs_keep_their_ids(plain, run):
    encoder = packing.tokenizer(packing.default_tokenizer())
    for text in ("x" + run + "y", run, run + "  'll", "é\n" + run):
        assert encoder.encode([text])[0] == array("I", plain.encode(text, add_special_tokens=False).ids).tobytes()


def test_ten_million_blanks_encode():
    encoder = packing.tokenizer(packing.default_tokenizer())
    for run in (" " * (10 * LONG), (" \n" * (5 * LONG))):
        assert len(encoder.encode(["x" + run + "y"])[0]) > 4 * LONG


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(" \n\t\r\x1c\x85\xa0ab's1!", max_size=12), st.sampled_from(" \n\t\x85\xa0"), st.sampled_from([0, 1, 4095, 4096, 4097])), max_size=4))
def test_runs_about_the_cut_keep_their_ids(plain, parts):
    text = "".join(a + b * n for a, b, n in parts)
    assert packing.tokenizer(packing.default_tokenizer()).encode([text])[0] == array("I", plain.encode(text, add_special_tokens=False).ids).tobytes()


def test_packing_of_long_runs(spark):
    texts = {i: "x" + run + "y" for i, run in enumerate(RUNS[:4])}
    rows = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), packing.default_tokenizer()).collect()
    for i in texts:
        assert sum(r.length for r in rows if r.doc_id == i) == next(r.doc_tokens for r in rows if r.doc_id == i)


# ---- files of patched blocks ----

NUMBERS = st.one_of(st.integers(0, 50_000), st.integers(0, 2**32 - 1), st.integers(0, 7))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(NUMBERS, min_size=1, max_size=400)), max_size=8), st.data())
def test_files_come_back(docs, data):
    ids = np.array([x for _, part in docs for x in part], dtype=np.uint32)
    raw = token_files.encode_file(ids, [i for i, _ in docs], [len(part) for _, part in docs])
    file = token_files.TokenFile(raw)
    assert [(i, list(part)) for i, _, part in file.documents()] == docs
    assert (file.ids(0, len(ids)) == ids).all()
    start = data.draw(st.integers(0, len(ids)))
    length = data.draw(st.integers(0, len(ids) - start))
    assert (file.ids(start, length) == ids[start : start + length]).all()


def test_files_of_all_widths_and_many_chunks(monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 3)
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 1 << w, 200, dtype=np.uint64).astype(np.uint32) for w in range(1, 33)] + [np.full(300, 2**32 - 1, dtype=np.uint32)])
    lengths = [1, 127, 128, 129, 1000, len(ids) - 1385]
    file = token_files.TokenFile(token_files.encode_file(ids, list(range(6)), lengths))
    assert (np.concatenate([x for *_, x in file.documents()]) == ids).all() and [s for _, s, _ in file.documents()] == list(np.cumsum(lengths) - lengths)


def test_outliers_go_to_exceptions():
    ids = np.full(128 * 50, 5, dtype=np.uint32)
    ids[::128] = 50_000  # one in a block: the width stays 0
    raw = token_files.encode_file(ids, [1], [len(ids)])
    file = token_files.TokenFile(raw)
    assert len(raw) < 50 * 12 + 8 * 50 + 200
    assert (file.ids(0, len(ids)) == ids).all()
    assert set(np.frombuffer(raw, dtype=np.uint8)[file.starts + 4]) == {0} and set(np.frombuffer(raw, dtype=np.uint8)[file.starts + 5]) == {1}


def test_damaged_files_are_refused():
    raw = token_files.encode_file(np.arange(500, dtype=np.uint32), [1], [500])
    for bad in (b"", raw[:-1], raw[:100] + b"\xff" + raw[101:], b"x" + raw[1:]):
        with pytest.raises(ValueError):
            token_files.TokenFile(bad)


@pytest.mark.parametrize("file_ids", [token_files.FILE_IDS, 500])
@pytest.mark.parametrize("many", [token_files.MANY, 0])
def test_token_documents(spark, plain, file_ids, many, monkeypatch):
    monkeypatch.setattr(token_files, "MANY", many)
    write = token_files.write_token_files
    monkeypatch.setattr(token_files, "write_token_files", lambda *a: write(*a, file_ids=file_ids))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    rows = [*docs.items(), (-5, ""), (-4, None), (None, "null id"), (7001, "a<|endoftext|>b"), (7002, "x" + " " * 5000), (7003, "twice"), (7003, "twice"), (7003, "else")]
    frame = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "doc_id long, text string, start int, file string")
    got = token_files.token_documents(frame, packing.default_tokenizer()).collect()
    ids = {text: array("I", [*plain.encode(text or "", add_special_tokens=False).ids, 0]).tobytes() for _, text in rows}
    assert sorted((-(10**9) if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got) == sorted((-(10**9) if k is None else k, ids[v]) for k, v in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_files.token_documents(frame.limit(0), packing.default_tokenizer()).count() == 0


def test_op12_against_the_plain_tokenizer(spark, plain):
    got = {r.doc_id: r for r in token_files.op12_patched_ids(spark, oracle.SF).collect()}
    at = 0
    for r in sorted(spark.read.parquet(f"{oracle.SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)
    assert len(got) > 0


# ---- fill in the middle ----

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def infilled(doc_id, text):
    text = text or ""
    units, d = UNITS.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_sql(spark):
    got = infill.op13_learned_infill(spark, oracle.SF)
    want = oracle.connect().sql(infill.OP13_SQL)
    assert sorted(map(repr, map(tuple, got.select(sorted(got.columns)).collect()))) == sorted(map(repr, want.select(", ".join(sorted(want.columns))).fetchall()))


@pytest.mark.parametrize("shard", [infill.SHARD_CHARS, 40])
def test_infill_of_odd_texts(spark, shard, monkeypatch):
    monkeypatch.setattr(infill, "SHARD_CHARS", shard)
    texts = ["", None, " ", "\n\t ", "a", " a ", "a b <P> c", "x<S", "<<S", "M><M", "𝄞 é ü z  \v\f", "word " * 5000, "x" * 100_000 + " y", " " * 100_000 + "y", "a b c d e f g h"]
    rows = [(i, t) for i in [None, *range(-2, 60)] for t in texts] + [(3, "a b c d e f g h")] * 2
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n int, output string")
    got = infill.fill_in_middle(frame)
    got = got.withColumn("back", infill.restored(got.output, got.form)).collect()
    want = sorted(((i, *infilled(i, t), t or "") for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(frame.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=600), st.sampled_from([1, 7, 100]))
def test_rank_index_is_exact_and_near(steps, miss):
    offsets = np.cumsum([0, *steps]).astype(np.int64)
    index = infill.RankIndex.fit(offsets, miss)
    ranks = np.arange(len(offsets))
    assert (index.offset(ranks) == offsets).all() and abs(index.predict(ranks) - offsets).max() <= miss + 1
    assert len(index.first) <= len(offsets)


def test_rank_index_needs_few_segments():
    rng = np.random.default_rng(0)
    offsets = np.cumsum(np.r_[0, rng.integers(2, 12, 200_000)])
    assert len(infill.RankIndex.fit(offsets).first) < 200


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(" \n\x0bab é", max_size=30), max_size=6))
def test_boundaries(texts):
    offsets, n = infill.boundaries(texts)
    assert n.tolist() == [len(UNITS.findall(t)) for t in texts]
    want, at = [0], 0
    for t in texts:
        want += [at + m.end() for m in UNITS.finditer(t)]
        at += len(t)
    assert offsets.tolist() == want


# ---- conversation repair ----


def every_repair(rows):
    """Least (cost, audit) by trying all edits, with up to two insertions in each place; and what it gives."""
    best, good = None, re.compile(r"(s?(ua)+)?")
    inserts = [()] + [(a,) for a in "ua"] + [(a, b) for a in "ua" for b in "ua"]

    def tried(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for more in inserts:
            c, a, o = cost + 3 * len(more), audit + "I" * len(more), out + [(x, {"u": "user", "a": "assistant"}[x], "") for x in more]
            if i == len(rows):
                if good.fullmatch("".join(x for x, _, _ in o)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, "\n".join(f"{r}:{t}" for _, r, t in o))
                continue
            role, text, fault = rows[i]
            tried(i + 1, c + 4, a + "D", o)
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] in ("s", "u", "a"):
                    tried(i + 1, c + extra, a + "K", o + [(role[:1], role, text)])
                for x, new in (("u", "user"), ("a", "assistant")):
                    tried(i + 1, c + extra + 3, a + "R", o + [(x, new, text)])

    tried(0, 0, "", [])
    return best


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        out.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def reported(rows):
    """rows: (turn, role, text) in order."""
    marks = faults_of([(r, t) for _, r, t in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, text = every_repair(marks)
    initials = [r[:1] for _, r, _ in rows]
    count = lambda f: sum(m[2] == f for m in marks)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", "blank", "duplicate", "truncated"])), max_size=3), st.integers(1, 3))
def test_agenda_finds_the_least_audit(rows, cut):
    pairs = [(role[:1] or "?", fault) for role, fault in rows]
    best = every_repair([(role, "", fault) for role, fault in rows])
    assert repair.whole_repair(pairs) == best[:2]
    values = {q: (0, 0, "") for q in repair.ENDS}
    blocks = [pairs[i : i + cut] for i in range(0, len(pairs), cut)]
    for block in reversed(blocks):
        values = repair.chain(repair.block_spans(block), len(block), values)
    if blocks:
        assert (values[0][0], values[0][2]) == best[:2]


def test_values_are_popped_in_order_and_the_goal_stops():
    popped = []
    rows = [("u", ""), ("a", "truncated"), ("t", "")] * 20

    def deduce(item, inner=repair.edits(rows)):
        popped.append(item)
        return inner(item)

    final = repair.lightest({(len(rows), q): (0, 0, "") for q in repair.ENDS}, deduce, [(0, 0)])
    values = [final[item] for item in popped]
    assert [v[:2] for v in values] == sorted(v[:2] for v in values) and len(set(popped)) == len(popped)
    assert popped == [item for item in final if item != (0, 0)] or (0, 0) in final


def plain_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))


@pytest.mark.parametrize("block", [repair.BLOCK_ROWS, 2])
def test_repair_of_odd_conversations(spark, block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(int(rng.integers(0, 5))):
            turn = [None, 0, 1, 2, 5, -3][rng.integers(6)]
            rows.append((conv, turn, ["system", "user", "assistant", "tool", "", None][rng.integers(6)], ["Hi.", "cut", "", " \n", None, "é?\t", "Hi."][rng.integers(7)]))
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string")
    reports, turns = repair.repair(frame)
    shas = {r.conv_id: r.repaired_sha256 for r in repair.digests(turns).collect()}
    got = {r.conv_id: (*r[1:], shas.get(r.conv_id, hashlib.sha256().hexdigest())) for r in reports.collect()}
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: reported(plain_rows(some)) for conv, some in conversations.items()}
    places = {}
    for r in turns.collect():
        places.setdefault(r.conv_id, []).append(r.place)
        assert (r.edit == "I") <= (r.turn is None and r.text == "")
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    empty, none = repair.repair(frame.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_hot_conversation_spreads_and_comes_back(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(7, int(t), "user" if t % 2 else "assistant", "same text." if rng.random() < 0.3 else f"text {t}" + "." * int(rng.random() < 0.8)) for t in range(900)]
    frame = spark.createDataFrame(rows + [(7, 900, "user", "again.")] * 300 + [(i, 0, "user", "x.") for i in (1, 9)], "conv_id long, turn long, role string, text string")
    want = {r.conv_id: r for r in repair.repair(frame)[0].collect()}
    monkeypatch.setattr(repair, "BLOCK_ROWS", 37)
    reports, turns = repair.repair(frame)
    assert {r.conv_id: r for r in reports.collect()} == want
    marks = faults_of([(r, t) for _, _, r, t in rows] + [("user", "again.")] * 300)
    assert (want[7].cost, want[7].audit) == repair.whole_repair([(r[:1], f) for r, _, f in marks])
    last = turns.filter("conv_id = 7").orderBy("place").collect()
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[0] for r in last))


def test_op11_sql(spark):
    got = repair.op11_agenda_repair(spark, oracle.SF)
    want = oracle.connect().sql(repair.OP11_SQL)
    assert sorted(map(repr, map(tuple, got.select(sorted(got.columns)).collect()))) == sorted(map(repr, want.select(", ".join(sorted(want.columns))).fetchall()))


def test_op11_of_damaged_rows(spark):
    """The damage by zlib, the repair by trying everything, over the conversations of at most four rows."""
    got = {r.conv_id: tuple(r)[1:] for r in repair.op11_agenda_repair(spark, oracle.SF).collect()}
    kept = {}
    for r in spark.read.parquet(f"{oracle.SF}/conversations.parquet").collect():
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        row = (r.turn, "user" if kind == 4 else r.role, "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text)
        kept.setdefault(r.conv_id, []).extend([row] * {0: 0, 3: 2}.get(kind, 1))
    assert set(got) == set(kept)
    tried = {conv: rows for conv, rows in kept.items() if len(rows) <= 4}
    assert len(tried) > 5 and all(got[conv] == reported(plain_rows(rows)) for conv, rows in tried.items())
