"""The ten operators against plain versions, and their cases: nulls, empty and long texts, ties, repeats, empty tables."""

import collections
import gc
import hashlib
import importlib.util
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provlake.llm import decontaminate, mixing, near_dup, pii, quality_classifier, quality_rules, suffix_dedup, token_counts, token_output, toxicity
from provlake.llm.queries import QUERIES, SQL, tokenizer_path
from provlake.llm.workspace import Workspace

_spec = importlib.util.spec_from_file_location("brute", os.path.join(os.path.dirname(__file__), "brute.py"))
brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(brute)

SF = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside.
CLASH = "score string, rank string, p string, k string, s string, size string, bucket string, n string, component_id string, kept string, _k string, row_key string"
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30000))


@pytest.fixture(scope="module")
def real():
    rows = duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()
    return [(d, t, a, b) for d, t, a, b in rows]


@pytest.fixture(scope="module")
def odd(real):
    """Real rows with the odd cases after them."""
    texts = [None, "", "   \n\t ", "a", "one two three", "Dear me\n\n" * 3, LONG, LONG + " end", "é ü 中文 　 x", real[3][1], "#### $$$$ !!!!"]
    return real[:60] + [(1000 + i, t, "en", "src1" if i % 2 else None) for i, t in enumerate(texts)]


def frame(spark, rows):
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return base.select("*", *[F.lit("x").alias(c.split()[0]) for c in CLASH.split(", ")])


def empty(spark):
    return frame(spark, []).limit(0)


def test_worker_keeps_one_operators_tables(monkeypatch):
    """The encoder of one operator goes when the worker's next task is another operator's."""
    task = type("Task", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)})
    monkeypatch.setattr("pyspark.TaskContext", task)
    held = lambda: sum(isinstance(x, token_output.Encoder) for x in gc.get_objects())
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two three four", "five six seven eight"])], ["doc_id", "text"])
    before = held()
    write = token_output._writer(tokenizer_path(), 2, 1 << 20)
    first = list(write(iter([batch])))
    assert held() == before + 1
    assert [r.equals(s) for r, s in zip(first, write(iter([batch])), strict=True)] == [True]
    assert held() == before + 1  # the same operator's next task finds it
    list(near_dup._signer(4)(iter([batch])))
    assert held() == before


def test_near_duplicates(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, odd), shingle=4).collect()}
    assert got == brute.near_dup([(d, t) for d, t, *_ in odd], 4)


def test_near_duplicates_large_group_in_blocks(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s"))
    rows += [(500 + i, rows[i % 5][1], "en", "s") for i in range(40)]
    want = brute.near_dup([(d, t) for d, t, *_ in rows], 5)
    for block in (1024, 20):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows), 5, block_docs=block).collect()}
        assert got == want
    assert len({c for _, c, _ in want.values()}) > 2


def test_near_duplicates_cases(spark, real):
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    rows = [(None, real[0][1], "en", "a"), (1, real[0][1], "en", "a"), (1, real[0][1], "en", "a")]
    got = sorted(near_dup.near_duplicates(frame(spark, rows)).select("doc_id", "component_id", "kept").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 1, True), (1, 1, True), (None, None, True)]
    assert near_dup.keep_one(frame(spark, rows)).columns == frame(spark, rows).columns


def test_texts_that_collide_modulo_two_to_the_64(spark):
    """The order of Thue and Morse and its complement have equal polynomials modulo 2^64, whatever the odd base."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    assert quality_rules.measure(pa.array([f"{one}\n{two}", f"{one} x y z q {two} x y z q", f"{one}\n{one}"]))[:, 3:5].tolist() == [[0, 0], [0, 0], [1, 0]]
    enc = token_output.Encoder(tokenizer_path())
    got = [x.tolist() for ids, n in enc.encode(pa.array([one, two])) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in enc.tok.encode_batch([one, two], add_special_tokens=False)] and got[0] != got[1]
    tail = " ".join(f"w{i}" for i in range(8))
    rows = [(1, f"{one} {tail}", "en", "a"), (2, f"{two} {tail}", "en", "a")]
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), 1, 90).collect()} == {1: 1, 2: 2}
    rows = [(i, "x" * 60 + t + "y" * 60, "en", "a") for i, t in enumerate((one, two))]
    got = {r.doc_id: tuple(r) for r in suffix_dedup.repeat_digest(suffix_dedup.find_repeats(frame(spark, rows))).collect()}
    assert got == {r[0]: r for r in brute.repeats([r[:2] for r in rows])}


def test_identities_fall_back_to_bytes(monkeypatch):
    from provlake.llm import textprims

    buf = np.frombuffer(b"ab cd ab ef cd gh", np.uint8)
    start = np.array([0, 3, 6, 9, 12, 15])
    want = [[i == j for j in (0, 1, 0, 2, 1, 3)] for i in (0, 1, 0, 2, 1, 3)]
    for _ in range(2):
        number, first = textprims.identities(buf, start, start + 2)
        assert (number[:, None] == number[None, :]).tolist() == want and (number[first] == np.arange(4)).all()
        monkeypatch.setattr(textprims, "span_hash", lambda prefix, s, e: np.zeros(len(s), np.uint64))


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.sort(x[:2000]), np.sort(x[1000:])
    sk = near_dup.sketches(np.concatenate([a, b, np.sort(x)]), np.array([0, 2000, 4000, 7000]))
    assert (near_dup.merge(sk[0], sk[1]) == sk[2]).all()
    # J of a and b is 1/3; of a and the union 2/3
    assert not near_dup.estimate_at_least(sk[0], 2000, sk[[1]], np.array([2000]), 0.6)[0]
    assert near_dup.estimate_at_least(sk[0], 2000, sk[[2]], np.array([3000]), 0.5)[0]


@pytest.mark.parametrize("hot", [None, 0])
def test_repeats(spark, odd, hot):
    rows = odd[:70] + [(2000 + i, "prefix %d " % i + odd[5][1][:300] + " suffix", "en", "s") for i in range(6)]
    rows = [r if r[1] is None else (r[0], r[1][:3000], *r[2:]) for r in rows]
    how = {} if hot is None else {"hot": hot, "hot_local": hot}
    out = suffix_dedup.repeat_digest(suffix_dedup.find_repeats(frame(spark, rows), **how))
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert got == {r[0]: r for r in brute.repeats([(d, t) for d, t, *_ in rows])}


def test_repeats_cases(spark, real):
    assert suffix_dedup.find_repeats(empty(spark)).count() == 0
    rows = [(None, real[0][1], "en", "a"), (5, real[0][1], "en", "a"), (5, real[0][1], "en", "a"), (7, real[0][1], "en", "a")]
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.repeat_digest(suffix_dedup.find_repeats(frame(spark, rows))).collect()}
    assert got == {(None, 0), (5, 0), (7, len(real[0][1].encode()))}


def test_parse_cuts_long_texts_the_same(monkeypatch):
    text = (LONG[:3000] + "\n").encode()
    buf, docs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    start, end, trigger, *_ = suffix_dedup.parse(buf, docs)
    assert start[0] == 0 and end[-1] == len(text) - suffix_dedup.LENGTH and (start[1:] == end[:-1]).all()
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    s2, e2, t2, *_ = suffix_dedup.parse(buf, docs)
    one, two = (np.repeat(t, e - s) for s, e, t in ((start, end, trigger), (s2, e2, t2)))
    assert (one == two).all()


def test_suffix_order():
    texts = [b"abcabcabc" * 12, b"xx" + b"abcabcabc" * 9, b"short"]
    got = suffix_dedup.suffix_order(texts)
    want = sorted((t[o:], d, o) for d, t in enumerate(texts) for o in range(len(t) - suffix_dedup.LENGTH + 1))
    assert got == [(d, o) for _, d, o in want]


def test_contamination(spark, odd):
    items = [(i, t) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()] + [(900, "three"), (901, None), (902, "  "), (None, "dear me"), (903, items_text(odd)), (904, items_text(odd))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination([(d, t) for d, t, *_ in odd], items), key=str)
    for block in (decontaminate.BLOCK_BYTES, 2000):
        got = decontaminate.contamination_digest(decontaminate.find_contamination(frame(spark, odd), bench, block_bytes=block))
        assert sorted(map(tuple, got.collect()), key=str) == want
        kept = decontaminate.drop_contaminated(frame(spark, odd), bench, block_bytes=block)
        assert kept.columns == frame(spark, odd).columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if not w[5]}
    plan = decontaminate.drop_contaminated(frame(spark, odd), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    none = decontaminate.find_contamination(frame(spark, odd), bench.limit(0))
    assert none.filter(F.size("hits") > 0).count() == 0 and none.count() == len(odd)
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0


def items_text(odd):
    return " ".join(odd[2][1].split()[:14]).upper()


def test_offsets_map_to_the_original():
    text = "x -- BIG,  é\ncat! y"
    _, ranges, _ = decontaminate.Matcher([("a", "Big é cat")]).scan(text)
    ((s, e),) = decontaminate.original_offsets(text, ranges)
    assert text[s:e] == "BIG,  é\ncat"


def test_matcher_against_plain_windows():
    rng = random.Random(1)
    for _ in range(60):
        words = [f"w{i}" for i in range(rng.choice([2, 5, 30]))]
        items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 9, 10, 11, 25])))) for i in range(12)] + [(None, "w1 w2"), ("x", None)]
        docs = [(i, " ".join(rng.choice([*words, "zz"]) for _ in range(rng.randint(0, 60))) + " " + (rng.choice(items)[1] or "")) for i in range(20)]
        matcher = decontaminate.Matcher(items)
        for (_, text), want in zip(docs, brute.contamination(docs, items), strict=True):
            n, ranges, found = matcher.scan(text)
            assert (n, sum(e - s for s, e in ranges), len(found)) == want[1:4]


def test_matcher_of_a_large_benchmark_is_small():
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "abcdefghijklmnop" for b in range(2000)]
    items = [(str(i), " ".join(words[k] for k in rng.integers(0, len(words), 200))) for i in range(700)]
    matcher = decontaminate.Matcher(items)
    nodes = matcher.auto.get_stats()["nodes_count"]
    assert nodes < 3 * len(matcher.flat)  # not ten nodes and more for each word
    assert matcher.scan("x " + items[9][1].upper() + " y")[1:] == ([(1, 201)], {"9"})


def test_personal_data(spark, odd):
    tricky = "a@b.c.d_e@f.g %x@y.zz 1.2.3.4.5.6.7.8 999.1.1.1 012.3.4.5 4111 1111 1111 1111 41111111111111112 +1 (017) 555-7713 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 é@x.y +4.9.(0"
    rows = odd + [(3000, tricky, "en", "s"), (3001, "9" * 40000, "en", "s"), (3002, "7 " * 20000 + "a" * 30000, "en", "s"), (3003, "+" * 3000 + "a@" * 3000, "en", "s")]
    keyed = [(4000 + i, f'token = "{hashlib.md5(str(i).encode()).hexdigest()}{i:08x}" words words', "en", "s") for i in range(40)] + [(5000 + i, f"on 2024-01-{i % 28 + 1:02d} version abc{i:07d}d", "en", "s") for i in range(40)]
    found = pii.find_personal_data(frame(spark, rows + keyed))
    got = {r.doc_id: r for r in pii.span_digest(found).collect()}
    for d, t, *_ in rows + keyed:
        base = brute.personal(t)
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in brute.KINDS]
    assert all(got[4000 + i].n_secret == 1 for i in range(40)) and not any(got[5000 + i].n_secret for i in range(40))
    assert pii.span_digest(pii.find_personal_data(empty(spark))).count() == 0
    plain = pii.span_digest(pii.find_personal_data(frame(spark, [(1, "only words", "en", "s"), (None, None, None, None)])))
    assert {(r.doc_id, r.spans) for r in plain.collect()} == {(1, ""), (None, "")}


def test_quality_rules(spark, odd):
    ledger = quality_rules.rule_ledger(frame(spark, odd))
    got = {r.doc_id: [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in ledger.collect()}
    assert got == {d: brute.measures(t) for d, t, *_ in odd}
    policy = quality_rules.POLICIES["full-1"]
    kept = quality_rules.apply_policy(ledger, policy)
    n = kept.filter("kept").count()
    masks = [r.fail_mask & policy.mask for r in ledger.collect()]
    for r in quality_rules.ablations(ledger, policy).collect():
        bit = 1 << [name for name, _ in quality_rules.RULES].index(r.rule)
        assert (r.n_failed, r.n_only, r.kept_without) == (sum(m & bit > 0 for m in masks), masks.count(bit), n + masks.count(bit))
    assert quality_rules.rule_ledger(empty(spark)).count() == 0


def test_token_shards_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = odd + [(None, "no id", "en", "s"), (odd[0][0], "same id, other text", "en", "s")]
    path = f"file://{tmp_path}/shards"
    token_output.write_token_shards(frame(spark, rows), path, tokenizer_path(), shard_tokens=5000)
    out = sorted(token_output.read_token_shards(spark, path).collect(), key=lambda r: r.start)
    at, texts = 0, collections.defaultdict(list)
    for d, t, *_ in rows:
        texts[d].append(t)
    assert [r.doc_id for r in out] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d))
    for r in out:
        sums = {zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in texts[r.doc_id]}
        assert r.start == at and r.ids_crc32 in sums
        at += r.n_tokens
    assert spark.read.parquet(path).count() > 3
    assert token_output.token_output(empty(spark), tokenizer_path()).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"])
def test_encoder_equals_whole_texts(name):
    enc = token_output.Encoder(tokenizer_path(name))
    rng = random.Random(2)
    parts = ["a", "b", "the", "1", "23", "'", "'s", "'t", "'re", " ", "  ", "\n", "\n\n", "\t", " \n ", ",", ".", "!!", "é", "×", "÷", "ß", " ", "　", "中", "́", "\x1c", "\x85", "\r\n", "-", "_", "ª", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(4000)] + ["x<|endoftext|>y", ""]
    got = []
    for i in range(0, len(texts), 300):
        for ids, n in enc.encode(pa.array(texts[i : i + 300])):
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == enc.ids_of(texts)


def test_repair_random_access():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 50, 400), 30).astype(np.uint32)
    sizes = np.array([1, 0, 999, 5000, 6000])
    seq, doc_symbols, rules = token_output.repair(ids, sizes, 50, least=4)
    assert len(seq) < len(ids) / 4 and (token_output.expand(seq, rules, 50) == ids).all()
    lengths = token_output.expansion_lengths(rules, 50)
    at = np.concatenate(([0], np.cumsum(doc_symbols)))
    start = np.concatenate(([0], np.cumsum(sizes)))
    for d in range(len(sizes)):
        assert (token_output.expand(seq[at[d] : at[d + 1]], rules, 50) == ids[start[d] : start[d + 1]]).all()
    for a, b in ((0, 1), (7, 4000), (11999, 12000), (5, 5), (0, 99999)):
        assert (token_output.token_range(seq, rules, lengths, 50, a, b) == ids[a:b]).all()


def test_mixing(spark, real):
    rows = real + [(7000, None, "en", "src0"), (7001, "", "en", None), (7002, "one two", "en", None), (None, "x y z", "en", "src3")]
    plan = mixing.mix_plan(frame(spark, rows), fan=4)
    got = plan.collect()
    again = mixing.mix_plan(frame(spark, rows).repartition(5), fan=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    source = {d: s for d, _, _, s in rows}
    size = collections.Counter()
    for d, t, _, s in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        share = left / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * share > 2 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * size[s] if s in capped else weight[s] * share for s in names}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(target[s]) and r.source_size == size[s] and 0 <= r.copies <= 2
        taken[s] += r["size"] * r.copies
        largest[s] = max(largest[s], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s]
    mixed = mixing.mix_documents(frame(spark, rows), fan=4)
    assert mixed.columns == frame(spark, rows).columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_plan(empty(spark)).count() == 0


def test_pivotal_rounding_keeps_expectations(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "a" if i % 3 else "b") for i in range(90)]
    total = collections.Counter()
    for seed in range(6):
        for r in mixing.mix_plan(frame(spark, rows), percent=70, weights=(1,), fan=8, seed=seed).collect():
            total[r.doc_id] += r.copies
    share = sum(total.values()) / (6 * len(rows))
    assert 0.5 < share < 0.9 and len({i for i in total if 0 < total[i] < 6}) > 45


def test_token_ledger(spark):
    ws = Workspace(spark, "test-ledger")
    ledger = token_counts.TokenLedger(spark, ws.file("ledger"))
    cols = "key string, tokenizer_version string, op string, source string, lang string, n_docs long, n_tokens long, seq long, score string"
    ev = lambda *rows: spark.createDataFrame([(*r, "x") for r in rows], cols)
    assert ledger.totals().count() == 0
    assert ledger.apply("1", ev(("1", "v", "insert", "a", "en", 1, 5, 0), ("1", "v", "insert", "a", "en", 1, 7, 1), ("2", "v", "insert", "a", None, 2, 3, 0), ("n", None, "insert", None, None, 1, None, 0)))
    one = {tuple(r) for r in ledger.totals().collect()}
    assert one == {("a", "en", "v", 1, 7), ("a", None, "v", 2, 3), (None, None, None, 1, 0)}
    batch = ev(("1", "v", "revise", "b", "en", 1, 9, 0), ("2", "v", "delete", "a", None, 1, 3, 0), ("9", "v", "delete", "a", "en", 1, 3, 0), ("3", "w", "insert", "a", "en", 1, 1, 0))
    before = ledger.commits()[-1]["parts"]
    assert ledger.apply("2", batch) and not ledger.apply("2", batch)
    two = {tuple(r) for r in ledger.totals().collect()}
    assert two == {("b", "en", "v", 1, 9), (None, None, None, 1, 0), ("a", "en", "w", 1, 1)}
    # the part of key n was not touched by the second batch
    assert set(before.values()) & set(ledger.commits()[-1]["parts"].values())
    assert ledger.apply("3", spark.createDataFrame([], cols))
    assert {tuple(r) for r in ledger.totals().collect()} == two and ledger.state().count() == 3
    with pytest.raises(Exception, match="without key"):
        ledger.apply("4", ev((None, "v", "insert", "a", "en", 1, 5, 0)))
    assert len(ledger.commits()) == 3


def test_token_ledger_survives_a_crash(spark, monkeypatch):
    ws = Workspace(spark, "test-ledger-crash")
    path = ws.file("ledger")
    cols = "key string, tokenizer_version string, op string, source string, lang string, n_docs long, n_tokens long, seq long"
    batch = spark.createDataFrame([("1", "v", "insert", "a", "en", 1, 5, 0)], cols)
    ledger = token_counts.TokenLedger(spark, path)
    real = token_counts.TokenLedger._commit

    def crash(self, number, entry):
        out = self._fs.create(self._Path(f"{self.path}/commits/.half"), False)
        out.close()
        raise OSError("lost before the marker was named")

    monkeypatch.setattr(token_counts.TokenLedger, "_commit", crash)
    with pytest.raises(OSError):
        ledger.apply("1", batch)
    monkeypatch.setattr(token_counts.TokenLedger, "_commit", real)
    again = token_counts.TokenLedger(spark, path)
    assert again.commits() == [] and again.totals().count() == 0
    assert again.apply("1", batch) and [tuple(r) for r in again.totals().collect()] == [("a", "en", "v", 1, 5)]
    # of two writers that saw the same commits the second fails and changes nothing
    with pytest.raises(Exception, match="already exists|AlreadyExists"):
        again._commit(0, {"batch": "2", "attempt": "x", "parts": {}})
    assert [c["batch"] for c in again.commits()] == ["1"]


def plain_counts(rows):
    """Totals by the tokenizers themselves: rows (doc_id, text, lang, source) after the three batches of the query."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    first = {}
    for d, t, *_ in rows:
        if d is not None and t is not None:
            first[t] = min(d, first.get(t, d))
    out: dict = collections.defaultdict(lambda: [0, 0])
    for d, t, lang, source in rows:
        if d is not None and t is not None and d > first[t]:
            continue
        for v, n in (("byte_bpe_50k.json", len(tok.encode(t or "", add_special_tokens=False).ids) + 1), ("byte_bpe_multi_50k.tiktoken", len(multi.encode_ordinary(t or "")))):
            out[source, lang, v][0] += 1
            out[source, lang, v][1] += n
    return {(*k, *v) for k, v in out.items()}


def test_token_counts_query_against_the_tokenizers(spark, odd, tmp_path):
    rows = odd + [(None, "no id", "en", "s"), (None, "no id", "en", "s"), (odd[0][0], odd[0][1], odd[0][2], odd[0][3]), (odd[0][0], "same id", "en", None), (9999, odd[1][1], "en", "s")]
    for name, table in (("some", rows), ("none", [])):
        frame(spark, table).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        got = QUERIES["op9_token_counts"](spark, f"file://{tmp_path}/{name}")
        assert got.columns == ["source", "lang", "tokenizer_version", "n_docs", "n_tokens"]
        assert {tuple(r) for r in got.collect()} == plain_counts(table)


def labelled(n, word, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))]
        if y := i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = word(rng)
        out.append((" ".join(w), int(y)))
    return out


def test_toxicity_learns_words_and_parts():
    rows = labelled(700, lambda r: "zorg" + "".join(r.choice("abcd") for _ in range(3)))
    model = toxicity.train(rows[:500], 0.25)
    score, count, _ = toxicity.score_texts(model, pa.array([t for t, _ in rows[500:]] + ["", None, "word " * 5000]))
    y = np.array([v for _, v in rows[500:]])
    assert ((score[:200] >= 0.5) == y).mean() > 0.93
    assert count[200] == 0 and score[200] < 0.5 and score[201] == score[200] and count[202] > 300
    again = toxicity.train(rows[:500], 0.25)
    assert (again["net"]["Ec"] == model["net"]["Ec"]).all()


def plain_window_logit(m, x):
    """One window (steps x input) through the network, step by step."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h = m["Uf"].shape[0]
    states = {}
    for s, steps in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        state, out = np.zeros(h), {}
        for t in steps:
            a, b = x[t] @ m[f"W{s}"] + m[f"c{s}"], state @ m[f"U{s}"]
            z, r = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
            c = np.tanh(a[2 * h :] + r * b[2 * h :])
            state = z * state + (1 - z) * c
            out[t] = state
        states[s] = out
    both = np.array([np.concatenate([states["f"][t], states["b"][t]]) for t in range(len(x))])
    e = np.exp(both @ m["a"] - (both @ m["a"]).max())
    return (e / e.sum()) @ both @ m["w"] + m["b"][0]


def test_network_forward_and_gradients():
    from provlake.llm.recurrent import CHAR_DIM, WINDOW, WORD_DIM, gradients, new_model, run

    rng = np.random.default_rng(4)
    m = new_model(4)
    inputs = rng.standard_normal((9, WORD_DIM + CHAR_DIM)).astype(np.float32)
    index = np.full((3, WINDOW), -1)
    for i, n in enumerate((WINDOW, 5, 1)):
        index[i, :n] = rng.integers(0, 9, n)
    logit = run(m, inputs, index)
    want = [plain_window_logit(m, inputs[row[row >= 0]]) for row in index]
    assert np.allclose(logit, want, atol=1e-4)
    d = np.array([0.7, -1.1, 0.4], np.float32)
    kept = run(m, inputs, index, keep=True)
    g, dx = gradients(m, inputs, index, d, kept)
    loss = lambda: float((run(m, inputs, index).astype(np.float64) * d).sum())
    for name, grad in [*((k, g[k]) for k in ("w", "a", "Uf", "Ub", "Wf", "Wb", "cf", "cb")), (None, dx)]:
        value = inputs if name is None else m[name]
        for at in np.argsort(-np.abs(grad).ravel())[:3]:
            old = value.ravel()[at]
            value.ravel()[at] = old + 0.02
            up = loss()
            value.ravel()[at] = old - 0.02
            down = loss()
            value.ravel()[at] = old
            assert (up - down) / 0.04 == pytest.approx(float(grad.ravel()[at]), rel=0.05, abs=2e-3), name


def test_quality_vectors_against_plain_sums():
    from provlake.llm import quality_classifier as Q

    texts = ["One two, two THREE four!", "five", "", "a b"]
    sums = Q.context_sums(pa.array(texts)).reshape(-1, Q.DIM)
    want = np.zeros_like(sums)
    for t in texts:
        slot, at, _, _ = Q.tokens(np.frombuffer((t + "\n").encode(), np.uint8), np.array([0, len(t) + 1]))
        assert at.tolist() == [0, len(slot)]
        for i in range(len(slot)):
            for j in range(max(0, i - Q.REACH), min(len(slot), i + Q.REACH + 1)):
                if i != j:
                    for k in range(Q.NONZERO):
                        want[slot[i], Q._AT[slot[j], k]] += Q._SIGN[slot[j], k]
    assert np.allclose(sums, want) and np.abs(want).sum() > 0
    vectors = Q.vectors_of(sums)
    pooled = Q.pool(vectors, pa.array(texts))
    slot, *_ = Q.tokens(np.frombuffer(b"a b\n", np.uint8), np.array([0, 4]))
    assert np.allclose(pooled[3, : Q.DIM], vectors[slot].mean(0), atol=1e-6) and not pooled[2, : 2 * Q.DIM].any()


@pytest.mark.parametrize("name", ["op1_token_output", "op2_pii_weak_supervision", "op6_toxicity", "op8_quality_classifier", "op10_mixing"])
def test_queries_without_sql_keep_their_contract(spark, name):
    kinds = {
        "op1_token_output": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op2_pii_weak_supervision": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "n_spans": "bigint"},
        "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op8_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op10_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    }[name]
    out = QUERIES[name](spark, SF)
    assert {k: v for k, v in out.dtypes if k in kinds} == kinds
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for (d,) in duckdb.sql(f"select doc_id from '{SF}/documents.parquet'").fetchall())
    for r in rows:
        if "held_out" in kinds:
            fold, held = (5, 0) if name == "op6_toxicity" else (3, 1)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if name == "op2_pii_weak_supervision":
            assert r.n_spans == len([x for x in r.spans.split(",") if x])


def test_windows_cover_and_overlap():
    from provlake.llm.recurrent import STRIDE, WINDOW, windows_of

    begin = np.array([0, 0, 5, 37, 337])
    owner, start, length = windows_of(begin)
    for d in range(4):
        n = begin[d + 1] - begin[d]
        s, k = start[owner == d] - begin[d], length[owner == d]
        assert len(s) == (0 if n == 0 else max(0, -(-(n - WINDOW) // STRIDE)) + 1)
        if n:
            assert (np.diff(s) == STRIDE).all() and s[-1] + k[-1] == n


def test_quality_classifier(spark):
    rows = [(t if not y else " ".join(w.upper() + "##" for w in t.split()), 1 - y) for t, y in labelled(400, lambda r: "x")]
    docs = frame(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(rows)] + [(9000, None, "en", "s"), (9001, "", "en", "s")])
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, model).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == rows[i][1] for i in held]) > 0.95
    whole = quality_classifier.context_sums(pa.array([t for t, _ in rows] + [None, ""]))
    assert np.allclose(quality_classifier.vectors_of(whole.reshape(-1, quality_classifier.DIM)), model[0])
    assert quality_classifier.score_quality(empty(spark), model).count() == 0
    nothing = quality_classifier.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score_quality(docs, nothing).collect()} == {0.0}


def test_labelled_models_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame(spark, odd)
    out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    assert {r.score for r in out.collect()} == {0.0} and toxicity.drop_toxic(docs, labels).count() == len(odd)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    cols = sorted(want.columns)
    assert set(cols) == set(got.columns)
    assert sorted(map(str, got[cols].astype(str).values.tolist())) == sorted(map(str, want[cols].astype(str).values.tolist()))


def test_word_vectors_write_sums_of_many_tasks_only(spark, real, monkeypatch):
    """What is written of 40 tasks' tables are sums of 16 of them at least but for the last, and the vectors are those of one task."""
    written, save = [], Workspace.save

    def counted(ws, df, name):
        out = save(ws, df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    docs = frame(spark, real[:120])
    many = quality_classifier.word_vectors(docs.repartition(40))
    chunks = quality_classifier.SLOTS * quality_classifier.DIM // quality_classifier.CHUNK
    assert written == [chunks * 3, chunks]
    assert np.array_equal(many, quality_classifier.word_vectors(docs.coalesce(1)))
    assert np.array_equal(quality_classifier.word_vectors(docs.limit(0)), quality_classifier.vectors_of(np.zeros((quality_classifier.SLOTS, quality_classifier.DIM))))
