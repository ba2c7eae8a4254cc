"""Operators on single documents against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import functools
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from codecflow.llm import chat, common, lm_scoring, packing, quality_classifier, quality_rules, sentencepieces, sharding, words
from codecflow.llm.common import gapless, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "One two.", "a b c a b c a b c", "x\ny\nx\n\n \nx", "#$% <b> ümlaut joined \U0001f600", "word " * 200, "\x1c one\x0btwo\x0cthree", " lead  and   trail ", "<|endoftext|> is text", "\x00 \x00", "ab" * 30_000]


def docs(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, rank long, h long"
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, "s", None if t is None else len(t), 1, 0.5, 3, 4) for i, t in rows], schema)


ROWS = [*enumerate(TEXTS), (3, TEXTS[3]), (3, "another text of the same id"), (None, "no id at all"), (None, None)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# -- sharding ----------------------------------------------------------------------------------------------------------------


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    r = random.Random(1)
    keys = [r.randrange(-(1 << 63), 1 << 63) for _ in range(2000)]
    for n in (1, 2, 7, 40):
        got = sharding.jump_hash(np.array(keys), n)
        assert got.tolist() == [jump(k % (1 << 64), n) for k in keys]
        grown = sharding.jump_hash(np.array(keys), n + 1)
        assert set(grown[grown != got]) <= {n} and abs((grown != got).mean() - 1 / (n + 1)) < 0.05
    with pytest.raises(ValueError):
        sharding.jump_hash(np.array([1]), 0)


def test_sharding(spark):
    got = sharding.shard(docs(spark, ROWS), 5).collect()
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in got], key=str) == sorted([(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key") for i, t in ROWS], key=str)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    assert sharding.shard(docs(spark, [])).isEmpty()


def test_gapless_with_one_hot_key(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("case when id % 3 = 0 then 0 else id % 11 end k", "id")
    got = collections.defaultdict(list)
    for r in gapless(df, "k", "n").collect():
        got[r["k"]].append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 5000


# -- packing --------------------------------------------------------------------------------------------------------------------


def ids_of(text):
    from tokenizers import Tokenizer

    return [*(Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids), 1]


@pytest.mark.parametrize("sequence, width", [(2048, 8), (64, 4)])
def test_packing(spark, sequence, width):
    got = packing.pack(docs(spark, ROWS), sequence=sequence, width=width).collect()
    want = collections.Counter()
    for i, t in ROWS:
        ids = np.array(ids_of(t), "<u4")
        for s in range(0, len(ids), sequence):
            want[i, s, len(ids[s : s + sequence]), zlib.crc32(ids[s : s + sequence].tobytes()), len(ids)] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= sequence
    assert packing.pack(docs(spark, [])).isEmpty()


def test_packing_has_one_worker_a_task(spark, monkeypatch):
    plans = []
    keep = common.checkpointed
    monkeypatch.setattr(common, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    packing.pack(docs(spark, ROWS))
    assert [p.count("MapInArrow") for p in plans] == [1]


def test_only_texts_with_a_special_string_need_the_tokenizer(monkeypatch):
    import tokenizers

    class Missing:
        from_file = None

    path = tokenizer_path("byte_bpe_50k.json")
    want = {t: ids_of(t) for t in ("One two.", "<|endoftext|> is text")}
    batch = lambda text: pa.record_batch([pa.array([7]), pa.array([text]), pa.array([3])], ["doc_id", "text", "task"])
    run = lambda text: [r for b in packing.cut(iter([batch(text)]), path, "<|endoftext|>", 4, 2) for r in b.to_pylist()]
    for text, ids in want.items():
        parts = [ids[k : k + 4] for k in range(0, len(ids), 4)]
        assert [(r["length"], r["ids_crc32"], r["cls"], r["__task"]) for r in run(text)] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes()), 0 if len(x) == 4 else -(-len(x) // 2), 3) for x in parts]
    monkeypatch.setattr(tokenizers, "Tokenizer", Missing)
    assert len(run("One two.")) and len(run("")) == 1
    with pytest.raises(TypeError):
        run("<|endoftext|> is text")


def test_lean_gives_memory_back_whatever_happens(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and len(calls) == 1
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda batches: (1 // b for b in batches))(iter([0])))
    assert len(calls) == 2


def test_fast_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    fast = packing.fast_encoder(path, whole)
    r = random.Random(2)
    texts = [t for t in TEXTS if t and "<|" not in t] + ["".join(r.choice("aB é'\n\t1#ß漢\U0001f600") for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert fast(t) == whole.encode(t, add_special_tokens=False).ids


def test_column_generation():
    r = np.random.default_rng(3)
    demand = r.integers(0, 500, 64)
    patterns, uses = packing.column_generation(demand, 64)
    assert np.allclose(sum(p * u for p, u in zip(patterns, uses)), demand) and all((p * np.arange(1, 65)).sum() <= 64 for p in patterns)
    plan = packing.rounded(demand, patterns, uses, 64)
    assert (sum(p * k for p, k in plan) == demand).all() and all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
    least = -(-int((demand * np.arange(1, 65)).sum()) // 64)
    assert sum(k for _, k in plan) <= max(math.ceil(uses.sum() - 1e-6), least) + 3
    assert packing.column_generation(np.zeros(8, np.int64), 8)[0] == [] and packing.layout(np.zeros(8, np.int64), 8).sequences == 0
    value, p = packing.best_pattern(np.array([0.1, 0.0, 0.5]), 7)
    assert math.isclose(value, 1.1) and p.tolist() == [1, 0, 2]


# -- pieces --------------------------------------------------------------------------------------------------------------------


def test_pieces(spark):
    lib = sentencepieces.Agenda(tokenizer_path("piece_bpe_32k.model")).lib
    got = sentencepieces.encode_decode(docs(spark, ROWS)).collect()
    want = []
    for i, t in ROWS:
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((lib.decode(ids) if ids else "").encode()).hexdigest()))
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert sentencepieces.encode_decode(docs(spark, [])).isEmpty()


def test_agenda_equals_the_library():
    a = sentencepieces.Agenda(tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(7)
    for _ in range(1500):
        t = "".join(r.choice("abcdehilnorst  .,'2²³▁\n漢é\U0001f600#<>0x") for _ in range(r.randint(0, 40)))
        assert a.encode(t) == a.lib.encode(t), t
    a.check()
    wrong = sentencepieces.Agenda(tokenizer_path("piece_bpe_32k.model"))
    wrong.rank = {p: -k for p, k in wrong.rank.items()}
    wrong.parts("thereof and otherwise")
    with pytest.raises(ValueError, match="differ"):
        wrong.check()


def test_parts_in_use_are_encoded_once(monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT_PARTS", 5)
    a, merged = sentencepieces.Agenda(tokenizer_path("piece_bpe_32k.model")), []
    merge = a.merge
    a.merge = lambda p: merged.append(p) or merge(p)
    r = random.Random(3)
    for _ in range(60):
        t = " ".join(["the", *("".join(r.choice("abcdeorst") for _ in range(r.randint(1, 60))) for _ in range(2))])
        assert a.encode(t) == a.lib.encode(t), t
        a.check()
    assert merged.count("▁the") == 1
    assert all(a.by_list(p) == a.by_agenda(p) for p in merged)


# -- chat ------------------------------------------------------------------------------------------------------------------------


def talk():
    r = random.Random(5)
    turns, control = [], "\\### Assistant: </turn> ok"
    for c in range(60):
        for k in range(r.randint(1, 14)):
            role = ("user", "assistant", "system", "a:b#")[k % 4 if c % 9 else 3]
            turns.append((c, k, role, ("hello", control, "same")[k % 3] if r.random() < 0.7 else f"text {r.random()} \n ### user: <"))
    turns += [(100, 0, None, None), (101, 0, "assistant", ""), (102, None, "user", "first"), (102, 0, "assistant", "later"), (103, 5, "user", "b"), (103, 5, "user", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    return turns + [(200 + k, n, ("user", "assistant")[n], control) for k in range(30) for n in range(2)]


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_chat(spark, size, monkeypatch):
    monkeypatch.setattr(chat, "TREE_TOKENS", size)
    turns = talk()
    df = spark.createDataFrame([(*t, "n", 1) for t in turns], "conv_id long, turn long, role string, text string, tree string, n int")
    by = collections.defaultdict(list)
    for c, n, role, text in turns:
        by[c].append((-1 if n is None else n, role or "", text or ""))
    want = {}
    for c, t in by.items():
        t.sort()
        loss = "".join(x for _, role, x in t if role == "assistant")
        want[c] = (len(t), hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in t).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.formatted(role, x)[0]) for _, role, x in t))
    nodes = chat.prefix_trees(df)
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(nodes).collect()} == want
    trees = collections.defaultdict(list)
    for r in nodes.collect():
        trees[r["tree"]].append(r)
    for rows in trees.values():
        rows.sort(key=lambda r: r["n"])
        place, path = 0, []
        for r in rows:
            if r["is_leaf"]:
                continue
            del path[r["depth"] :]
            above = sum(len(x["tokens"]) for x in path)
            assert r["start"] == place and r["positions"] == list(range(above, above + len(r["tokens"])))
            path.append(r)
            seen = {k for i in r["intervals"] for k in range(i["lo"], i["hi"])}
            assert seen == {k for x in path for k in range(x["start"], x["start"] + len(x["tokens"]))}
            place += len(r["tokens"])
    if size > 200 and spark.sparkContext.defaultParallelism:
        assert sum(not r["is_leaf"] for rows in trees.values() for r in rows) < len(turns)
    assert chat.read_back(chat.prefix_trees(df.limit(0))).isEmpty()


def test_shared_turns_at_any_depth(spark):
    said = lambda c: [(c, n, ("user", "assistant")[n % 2], f"turn {n}") for n in range(9 if c != 2 else 8)] + ([(2, 8, "user", "else")] if c == 2 else [])
    df = spark.createDataFrame([t for c in (1, 2, 3) for t in said(c)], "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # so that no border between tasks cuts the tree
    try:
        nodes = chat.prefix_trees(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(not x["is_leaf"] for x in nodes) == 10 and sum(x["is_leaf"] for x in nodes) == 3


def test_escapes():
    for t in ("", "\\", "###", "</turn>\n", ": \\### a: b</turn>", "\\\\#"):
        assert chat.unescape(chat.escape(t)) == t
        assert chat._TURN.fullmatch(chat.formatted("user", t)[0]) and not re.search(r"(?<!\\)[#<]", re.sub(r"\\\\", "", chat.escape(t)))


# -- quality rules -----------------------------------------------------------------------------------------------------------------


def brute_features(text):
    text = text or ""
    w = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_features(spark):
    r = random.Random(3)
    rows = ROWS + [(100 + k, " ".join(r.choice("abcd") for _ in range(r.randint(0, 60))) + "\n" + "line\n" * (k % 3)) for k in range(60)]
    rows = [(i, t) for i, t in rows if t is None or "\x00" not in t or True]
    got = quality_rules.judge(docs(spark, rows), labels(spark, [])).collect()
    want = sorted([(i, *brute_features(t)) for i, t in rows], key=str)
    assert sorted([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got], key=str) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.judge(docs(spark, []), labels(spark, [])).isEmpty()


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(1, 0), (10, 0), (100, 3), (1000, 20), (5000, 40), (40, 1), (31, 0), (33, 1)]
    rows = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.04).alias("p")).collect()
    for r in rows:
        exact = math.fsum(math.comb(r["n"], i) * 0.04**i * 0.96 ** (r["n"] - i) for i in range(r["k"] + 1)) if r["n"] <= 1000 else None
        if r["k"] > r["n"] * 0.04:
            assert r["p"] == 1.0
        elif exact is not None:
            assert math.isclose(r["p"], exact, rel_tol=1e-9)
        else:
            assert 0 < r["p"] < 1e-20


def test_thresholds_reject_junk_and_spare_good(spark):
    r = random.Random(8)
    plain = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(70))
    rows = [(i, plain() if i % 6 else " ".join(w + "%%%" for w in plain().split())) for i in range(4000)]
    marked = [(i, int(i % 6 != 0), 0) for i, _ in rows if i % 4 != 3] + [(5, 1, 0), (None, 1, 0)]
    df = docs(spark, rows)
    got = {x["doc_id"]: x["kept"] for x in quality_rules.judge(df, labels(spark, marked)).collect()}
    assert not any(got[i] for i in got if i % 6 == 0) and sum(not got[i] for i in got if i % 6) <= 0.05 * len(rows)
    kept = quality_rules.keep_good(df, labels(spark, marked))
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.select("doc_id").collect()} == {i for i in got if got[i]}
    few = {x["doc_id"]: x["kept"] for x in quality_rules.judge(df, labels(spark, marked[:30])).collect()}
    assert all(few.values())  # so few labels certify nothing


def test_every_large_language_is_a_stratum(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LEAST_IN_STRATUM", 20)
    r = random.Random(9)
    plain = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(52))
    langs = [f"l{k:02}" for k in range(64) for _ in range(21)] + [None] * 6000 + ["zz"] * 20
    rows = [(i, plain() if x != "zz" else " ".join(w + "%" for w in plain().split()), x) for i, x in enumerate(langs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marked = labels(spark, [(i, 1, 0) for i, _, _ in rows])
    assert {x["kept"] for x in quality_rules.judge(df, marked).where("lang = 'zz'").collect()} == {True}
    assert quality_rules.keep_good(df, marked).where("lang = 'zz'").count() == 20
    junk = spark.createDataFrame([(10**6, rows[-1][1], None), (10**6, rows[-1][1], "never labelled")], "doc_id long, text string, lang string")
    judged = {x["lang"]: x["kept"] for x in quality_rules.judge(df.unionAll(junk), marked).where("doc_id = 1000000").collect()}
    assert judged == {None: False, "never labelled": True}  # only the documents without a language have cutoffs


def test_strata_borrow_no_cutoffs(spark):
    r = random.Random(10)
    plain = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(52))
    dirty = lambda: " ".join(w + "%" for w in plain().split())
    rows = [(lang, f()) for k in range(21) for lang, f, n in [(f"l{k}", plain, 480)] for _ in range(n)] + [("few", dirty())] * 45
    rows += [("aa", plain()) for _ in range(1400)] + [("bb", dirty()) for _ in range(1400)] + [("aa", dirty())]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = quality_rules.judge(df, labels(spark, [(i, 1, 0) for i in range(len(rows) - 1)])).groupBy("lang").agg({"kept": "min", "doc_id": "count"}).collect()
    assert {x["lang"] for x in got if not x["min(kept)"]} == {"aa"}  # its one dirty document; what is normal in bb stays


# -- classifier ---------------------------------------------------------------------------------------------------------------------


def test_classifier(spark):
    r = random.Random(4)
    good = lambda: ". ".join(" ".join("".join(r.choice("aeioulnst") for _ in range(r.randint(2, 7))) for _ in range(9)).capitalize() for _ in range(5))
    bad = lambda: " ".join(w.upper() + "!!" for w in good().split())
    rows = [(i, good() if i % 3 else bad()) for i in range(600)]
    df = docs(spark, rows + [(1000, ""), (1001, None), (1000, "")])
    marked = labels(spark, [(i, int(i % 3 != 0), 0) for i, _ in rows] + [(None, 1, 0), (2, None, 0)])
    got = quality_classifier.classify(df, marked).collect()
    assert len(got) == 603 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got)
    for x in got:
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
    held = [x["predicted"] == int(x["doc_id"] % 3 != 0) for x in got if x["held_out"] and x["doc_id"] < 600]
    assert np.mean(held) > 0.97
    kept = quality_classifier.keep_good(df.where("doc_id < 600"), marked)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {x["doc_id"] for x in got if x["predicted"] and x["doc_id"] < 600}
    assert {x["score"] for x in quality_classifier.classify(df, labels(spark, [])).collect()} == {0.5}
    assert quality_classifier.classify(docs(spark, []), marked).isEmpty()


def test_votes_equal_a_plain_count_with_ties():
    r = np.random.default_rng(6)
    rows = np.abs(r.normal(size=(60, quality_classifier.TERMS))).astype(np.float32)
    rows[10:30] = rows[:1]  # twenty alike, on both sides of the last neighbour
    labels = (np.arange(60) % 3 == 0).astype(float)
    model = quality_classifier.train(rows, labels, latent=8, neighbours=5)
    got = model.score(rows)
    sims = model.latent(rows) @ model.vectors.T
    for i in range(60):
        order = sorted(range(60), key=lambda j: -sims[i, j])
        near = [j for j in range(60) if sims[i, j] >= sims[i, order[4]]]
        weight = [max(float(sims[i, j]), 0.0) ** 8 + 1e-9 for j in near]
        assert math.isclose(got[i], min(1, sum(w * labels[j] for w, j in zip(weight, near)) / sum(weight)), abs_tol=1e-9)
    back = r.permutation(60)
    other = quality_classifier.train(rows, labels, latent=8, neighbours=5)
    other.vectors, other.labels = other.vectors[back], other.labels[back]
    assert np.allclose(other.score(rows), got, atol=1e-5)  # whatever the order of the labelled vectors


def test_held_out_labels_are_never_learnt(spark):
    r = random.Random(6)
    df = docs(spark, [(i, " ".join(r.choice("abcdef") for _ in range(20))) for i in range(200)])
    marks = [(i, int(i % 2), 0) for i in range(200)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in marks]
    a, b = ({x["doc_id"]: x["score"] for x in quality_classifier.classify(df, labels(spark, m)).collect()} for m in (marks, turned))
    assert a == b


# -- language model -------------------------------------------------------------------------------------------------------------------


def lm_rows():
    r = random.Random(11)
    common = ["the", "of", "and", "to", "in", "Zé"]

    def text():
        out, k = [], 0
        for _ in range(r.randint(0, 60)):
            k = (k + 1) % 6 if r.random() < 0.8 else r.randrange(6)
            out.append(common[k] if r.random() < 0.8 else f"w{r.randrange(400)}")
        return " ".join(out)

    return [(i, text()) for i in range(220)] + ROWS


def small_model(monkeypatch, bucket, block, hot=4096, marks=1 << 27):
    for name, value in (("BUCKET", bucket), ("BLOCK", block), ("HOT", hot), ("MARK_BITS", marks), ("_RANGE_BITS", marks // 16), ("_FLUSH", 50 if bucket < 100 else 1 << 22)):
        monkeypatch.setattr(lm_scoring, name, value)


def test_base_scores(spark):
    rows = lm_rows()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted([(i, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows], key=str)
    got = lm_scoring.scores(docs(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], key=str) == want
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def brute_model(rows, held):
    """p(n-gram) and all tokens: trigrams with every word and n-gram of count 2, straight from the definitions."""
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    grams = [collections.Counter() for _ in range(4)]
    for i, t in rows:
        if not held(i):
            x = ["start", *tokens(t)]
            for n in (1, 2, 3):
                grams[n].update(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
    texts = grams[1].pop(("start",))
    total, kinds, words = sum(grams[1].values()), len(grams[1]), [g[0] for g in grams[1]]
    grams[1][("start",)] = texts
    follow = collections.defaultdict(list)
    for n in (2, 3):
        for g, c in grams[n].items():
            if c >= 2:
                follow[g[:-1]].append(c)

    @functools.cache
    def p(g):
        if len(g) == 1:
            return (grams[1][g] + 1) / (total + kinds + 1)
        mine, of = follow[g[:-1]], grams[len(g) - 1][g[:-1]]
        if not mine:
            return p(g[1:])
        c = grams[len(g)][g]
        return max(c - 0.75 if c >= 2 else 0, 0) / of + (1 - sum(x - 0.75 for x in mine) / of) * p(g[1:])

    return p, words, tokens


def brute_scores(rows, held):
    p, _, tokens = brute_model(rows, held)
    scored = lambda x: sum(math.log10(p(tuple(x[max(0, k - 2) : k + 1]))) for k in range(1, len(x)))
    return sorted([(i, round(scored(["start", *tokens(t)]), 6)) for i, t in rows], key=str)


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_the_model_is_a_distribution():
    p, words, _ = brute_model(lm_rows(), held_out)
    for context in (("start",), (b"the",), (b"the", b"of"), ("start", b"and"), (b"w1",), ()):
        assert math.isclose(sum(p((*context, w)) for w in [*words, "unknown"]), 1), context


@pytest.mark.parametrize("sizes", [(1 << 21, 1 << 22), (1 << 21, 100, 4, 64), (50, 100, 4, 1 << 14), (40, 1 << 22, 1, 1 << 10)])
def test_scores_equal_plain_backoff(spark, sizes, monkeypatch):
    small_model(monkeypatch, *sizes)
    rows = lm_rows()
    got = lm_scoring.scores(docs(spark, rows)).collect()
    assert sorted([(r["doc_id"], round(r["score"], 6)) for r in got], key=str) == brute_scores(rows, held_out)


def test_words_are_hashed_as_they_are_split(monkeypatch):
    r = random.Random(3)
    texts = [*TEXTS, "x" * 5000 + " y", "İ Ünder A\tB"] + ["".join(r.choice("abÄ \tC\n\x1c") for _ in range(r.randint(0, 200))) for _ in range(200)]
    for size in (7, 64, 1 << 16):
        monkeypatch.setattr(words, "PIECE", size)
        h, n = words.Hasher().of(pa.array(["before", *texts]).slice(1))
        split = [(t or "").encode().lower().split() for t in texts]
        assert n.tolist() == [len(x) for x in split]
        of = dict(zip((x for t in split for x in t), h.tolist()))
        assert [of[x] for t in split for x in t] == h.tolist() and len(set(of.values())) == len(of)
    keys = words.distinct(h)
    q = np.r_[keys[::2], np.uint64(5), keys[::3] + np.uint64(1)]
    want = [int(np.flatnonzero(keys == x)[0]) if x in set(keys.tolist()) else len(keys) for x in q.tolist()]
    assert words.Index(keys).places(q).tolist() == want and words.Index(keys[:0]).places(q[:2]).tolist() == [0, 0]


def test_no_training_text(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm_scoring.scores(docs(spark, [(one, "a b")])).collect()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (True, 3, 0, 0, 0.0, 0.0)
    assert lm_scoring.scores(docs(spark, [])).isEmpty()


# -- registry and pipeline -----------------------------------------------------------------------------------------------------------


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_", x)[0] for x in names if x.startswith("op") and re.match(r"op\d+_", x)} and "pipeline" in names


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(240):
        text = " ".join(word() for _ in range(90))
        if i % 10 == 0:
            text = " ".join(w.upper() + "%%%" for w in text.split())
        elif i % 10 == 1:
            text = rows[-2][1] if i > 10 else text
        elif i % 10 == 2:
            text = "\n".join([text, passage])
        elif i % 10 == 3:
            text = "short"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, [(i, int(i % 10 != 0), 0) for i in range(0, 240)]).write.parquet(str(tmp_path / "labels.parquet"))
    docs_ = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, counts = docs_.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs_ = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs_.columns == columns, name
        counts.append(docs_.count())
    before = {x["doc_id"]: x["text"] for x in spark.read.parquet(str(tmp_path / "stage2")).collect()}
    after = {x["doc_id"]: x["text"] for x in spark.read.parquet(str(tmp_path / "stage3")).collect()}
    assert counts[0] <= 240 - 24 and set(before) == set(after)
    assert not [i for i in after if i in (1000, 1001) or i % 10 == 3] and not [i for i in after if i % 10 == 0]
    assert all(passage not in after[i] for i in after) and sum(i % 10 > 3 for i in after) == 144
    packed = spark.read.parquet(str(tmp_path / "stage4")).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in packed} == {i: len(ids_of(t)) for i, t in after.items()}
    assert sorted(map(json.dumps, ([x["doc_id"], x["start"], x["length"]] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(json.dumps, ([x["doc_id"], x["start"], x["length"]] for x in spark.read.parquet(str(tmp_path / "stage4")).collect())))
