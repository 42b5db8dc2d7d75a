"""Importance resampling, token alignment and personal data against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, place long, part int, w int"
WORDS = "the of and to a in is it you that he was for on are with as his they be at one have this from".split()
EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "the word " * 30), (5, "the word " * 30), (5, "the other " * 30), (None, "und so weiter, " * 20), (None, None),
    (-7, "Straße Ärger ÀÉ ſ K 日本語 " * 9), (1 << 60, "a<|endoftext|>b <s> ▁ x  y\n\n z " * 5), (8, "x" * 200 + " 12345 " * 40), (9, " lead  and   trail \n\t x y z \r\n" * 3),
    (10, "tab\tsep don't I'LL\x1c\x1d \x85 a b"), (11, "null\x00byte 🙂🙂 é"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", k, k, k) for k, (d, t) in enumerate(EDGE)], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def importance_brute(rows, target, ngrams=1, buckets=10000, percent=10, seed=2024):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]

    at = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(at, features(text)[1]))
    for text in target:
        t.update(map(at, features(text)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out, able = [], []
    for k, (d, text) in enumerate(rows):
        n, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(at(x)) for x in f) // len(f) if f else 0
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            able.append(k)
    able.sort(key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0))
    for place, k in enumerate(able[: percent * len(able) // 100], 1):
        out[k][4] = place
    return [tuple(x) for x in out]


def test_importance(spark, docs, real, benchmark):
    from terraloom.llm import importance as m

    target = [r["text"] for r in benchmark.collect()]
    for df in (docs, real):
        same([tuple(r) for r in m.query(df, benchmark).collect()], importance_brute(rows_of(df), target))
    got = m.importance_ranks(real, benchmark, ngrams=2, buckets=997, percent=35, seed=5).drop("text_key").collect()
    same([tuple(r) for r in got], importance_brute(rows_of(real), target, 2, 997, 35, 5))
    assert m.query(real.limit(0), benchmark).count() == 0
    same([tuple(r) for r in m.query(docs, benchmark.limit(0)).collect()], importance_brute(rows_of(docs), []))


def test_resampled_documents_keep_their_columns(docs, benchmark):
    from terraloom.llm import importance as m

    out = m.resample(docs, benchmark, percent=100)
    assert out.columns == [*docs.columns, "__rank"]
    want = {(d, t) for d, t in EDGE if t and len(m.words_of(t)) >= 20}
    assert Counter(rows_of(out)) == Counter(want) and all(r["place"] == r["part"] == r["w"] for r in out.collect())


@pytest.mark.parametrize("ids", [range(-3, 4), [-(1 << 63), (1 << 63) - 1, 0, 5, None], [7], [None, None]])
def test_radix_ranks(spark, ids):
    from terraloom.llm import importance as m

    rng = random.Random(2)
    rows = [(rng.choice(list(ids)), rng.choice([0, 3, -2, 70_000, -90_000])) for _ in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, score long")
    for bits, part_rows in ((11, 1 << 20), (3, 50)):
        ranked = sorted(m.radix_ranked(table, m.key_digits(table, bits), part_rows=part_rows, bits=bits).collect(), key=lambda r: r["place"])
        assert [r["place"] for r in ranked] == list(range(700))
        assert [(r["doc_id"], r["score"]) for r in ranked] == sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))


def test_counting_passes_are_stable_and_shuffle_once(spark):
    from terraloom.llm import importance as m

    table = spark.range(5000).selectExpr("id as place", "cast(id div 700 as int) as part", "cast(hash(id) & 15 as int) as d")
    done = m.counting_pass(table, F.col("d"), 8, 16)
    got = sorted(done.collect(), key=lambda r: r["place"])
    want = sorted(table.collect(), key=lambda r: (r["d"], r["place"]))
    assert [(r["d"], r["part"]) for r in got] == [(r["d"], r["part"]) for r in want] and [r["place"] for r in got] == list(range(5000))


def tokens_brute():
    import public_tokenizers as files
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in letters} | {chr(256 + k): c for k, c in enumerate(x for x in range(256) if x not in letters)}

    def both(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        bytes_a = [bytes(back[c] for c in t) for t in x.tokens]
        names = [b.id_to_piece(i) for i in y]
        bytes_b = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(y, names, strict=True)]
        want = (" " + text).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return [], []
        return list(zip(x.ids, map(len, bytes_a), strict=True)), list(zip(y, map(len, bytes_b), strict=True))

    return both


def alignment_brute(rows):
    both, held, docs = tokens_brute(), defaultdict(set), []
    for k, (d, text) in enumerate(rows):
        a, b = both(text)
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        while i < len(a):
            group = [], []
            while True:
                if at_a <= at_b:
                    group[0].append(a[i][0])
                    at_a, i = at_a + a[i][1], i + 1
                else:
                    group[1].append(b[j][0])
                    at_b, j = at_b + b[j][1], j + 1
                if at_a == at_b:
                    break
            groups.append(group)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        for pair in links:
            held[pair].add(k)
        docs.append((d, len(a), len(b), groups, links))
    top = Counter()
    for (x, _), who in held.items():
        top[x] = max(top[x], len(who))
    out = []
    for d, n_a, n_b, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for (x, y), n in links.items() if len(held[x, y]) == top[x])
        total = sum(n * len(held[pair]) for pair, n in links.items())
        out.append((d, n_a, n_b, len(groups), sum(links.values()), best, total, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, {(x, y): len(who) for (x, y), who in held.items()}


def test_alignment(spark, docs, real, monkeypatch):
    from terraloom.llm import token_alignment as m

    for df in (docs, real):
        rows, pairs = m.align(df)
        want, held = alignment_brute(rows_of(df))
        same([tuple(r) for r in rows.collect()], want)
        assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == held
    # Many blocks and deals give the same rows.
    few, _ = m.align(real.repartition(7), task_bytes=20_000)
    same([tuple(r) for r in few.collect()], want)
    assert m.query(docs.limit(0)).count() == 0
    assert m.query(docs.where("text is null")).where("n_a = 0 and groups_sha256 = '' and count_sum = 0").count() == 2


def test_blocks_of_hard_texts(monkeypatch):
    """Random texts, and groups so wide that they are counted by distinct ids, against the loops over one document each."""
    from terraloom.llm import token_alignment as m

    rng = random.Random(6)
    alphabet = [*"abcXYZ019.,'!$%", " ", " ", " ", "\n", "\t", "\xa0", "\x1c", "\x85", "é", "日本", "🙂", " the", " and", "'s", "ing", "<s>", "<0x41>", "▁"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["日本" * 900, "🙂" * 500 + "x", None]
    want, _ = alignment_brute(list(enumerate(texts)))
    for wide in (1024, 1):
        monkeypatch.setattr(m, "WIDE", wide)
        aligner = m.Aligner()
        rows, keys, times = aligner.block(aligner.tokens(texts))
        assert [(k, *r[:4], r[4]) for k, r in enumerate(rows)] == [(w[0], *w[1:5], w[7]) for w in want]
        got = Counter()
        for _, run in m.runs_of(keys, times):
            pairs, docs, links = m.unpacked_run(run)
            assert (np.diff(pairs) >= 0).all()
            for d, n in zip(docs.tolist(), links.tolist(), strict=True):
                got[d] += n
        assert all(got[k] == w[4] for k, w in enumerate(want))


def test_runs_and_their_merge():
    from terraloom.llm import token_alignment as m

    rng, runs, want = np.random.default_rng(3), [], Counter()
    for _ in range(5):
        sets = [np.unique(rng.integers(0, 1 << 20, rng.integers(0, 300))) << 8 for _ in range(9)]
        for x in sets:
            want.update(x.tolist())
        keys = np.sort(np.concatenate([m._keys(x, np.full(len(x), k)) for k, x in enumerate(sets)]))
        runs += [run for _, run in m.runs_of(keys, np.ones(len(keys), np.int64))]
    got = [(int(p), int(n)) for pairs, counts in m.merged_counts(runs) for p, n in zip(pairs, counts, strict=True)]
    assert dict(got) == dict(want) and len(got) == len(want)
    heads = [int(pairs[0]) >> 16 for pairs, _ in m.merged_counts(runs)]
    assert heads == sorted(set(heads))


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = sum((2 * d - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((k, m.start(), m.end()))
    return out


def spans_text(spans):
    return ",".join(f"{(*[k for k, _ in BASE], *['ctx_' + k for k, _ in BASE])[k]}:{a}:{b}" for k, a, b in spans)


def bootstrap_brute(rows):
    """Added spans by plain loops over sets and dictionaries; the sites are those of the operator."""
    from terraloom.llm.pii_bootstrap import sites_of

    every = [sites_of(t)[1] for _, t in rows]
    fits = {v: f for s in every for v, k, *_, f in s if k < 0}
    sites = [[x[:-1] for x in s] for s in every]
    seeds = {v for s in sites for v, k, *_ in s if k >= 0}
    edges = {(p, v, k) for s in sites for v, k, _, _, *ps in s if k >= 0 or v not in seeds for p in ps}
    known, unknown = defaultdict(set), defaultdict(set)
    for p, v, k in edges:
        (known if k >= 0 else unknown)[p].add(v)
    scores, before = {}, None
    for _ in range(6):
        support, own = Counter(), Counter()
        for p, v, k in edges:
            if k >= 0:
                support[p, k] += 1.0
                own[p, k] += 1
            for kind in range(4):
                if k < 0 and (v, kind) in scores:
                    support[p, kind] += scores[v, kind]
        share = lambda pk: support[pk] / (support[pk] + len(known[pk[0]]) - own[pk] + 0.1 * (len(unknown[pk[0]]) - support[pk] + own[pk]))  # noqa: E731, B023
        speaking = {pk: share(pk) for pk, n in support.items() if n > 3 - 1e-9 and share(pk) > 0.8 - 1e-9}
        doubts = defaultdict(lambda: 1.0)
        for p, v, k in edges:
            for kind in range(4):
                if k < 0 and fits[v] >> kind & 1 and (p, kind) in speaking:
                    doubts[v, kind] *= max(1 - speaking[p, kind], 1e-12)
        scores = {x: 1 - d for x, d in doubts.items()}
        if before == set(speaking):
            break
        before = set(speaking)
    kind_of = {}
    for v in {v for v, _ in scores}:
        best = max(range(4), key=lambda k: (round(scores.get((v, k), -1), 9), -k))
        if scores[v, best] >= 0.8 - 1e-9:
            kind_of[v] = best
    return [sorted({(4 + kind_of[v], a, b) for v, k, a, b, *ps in s if k < 0 and v in kind_of and any((p, kind_of[v]) in speaking for p in ps)}) for s in sites]


@pytest.fixture(scope="module")
def contexts(spark):
    rng = random.Random(9)
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    filler = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 9)))
    rows = []
    for _ in range(12):
        rows.append(f"{filler()} please call +1 ({number(3)}) 555-{number(4)} before noon {filler()}")
    for k in range(9):  # found by the first round, and what they teach finds the others
        rows.append(f"{filler()} please call 0{number(3)}/{number(6)} before noon. Office line 0{k}00/123456{k} is open {filler()}")
        rows.append(f"Reach us: please call 0{k}00/123456{k} before noon")
    rows += [f"{filler()} Office line 0{number(3)}/{number(6)} is open {filler()}" for _ in range(2)]
    rows += [f"{filler()} order number {number(8)} was shipped {filler()}" for _ in range(8)]
    rows += [f"{filler()} write to user{k}@mail.example.org today" for k in range(5)] + ["write to someone@localhost today"]
    rows += ["no digits here", "", None, "1.2.3.4.5.6.7.8 999.1.1.1 10.0.0.1", "4111 1111 1111 1111, 4111-1111-1111-1112 +49 30 1234567 a@b.c@d.e.f -.%@x.y"]
    rows += rows[:3]
    return spark.createDataFrame([(k if k % 9 else None, t, k, k) for k, t in enumerate(rows)], "doc_id long, text string, row long, v int")


def test_personal_data(docs, real, contexts):
    from terraloom.llm import pii_bootstrap as m

    for df in (docs, real, contexts):
        rows = rows_of(df)
        want = []
        for (d, t), added in zip(rows, bootstrap_brute(rows), strict=True):
            base = base_brute(t)
            counts = [sum(k == kind for k, *_ in base) for kind in range(4)]
            want.append((d, *counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text([*base, *added]), len(added)))
        same([tuple(r) for r in m.query(df).collect()], want)
    assert m.query(real.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(contexts):
    from terraloom.llm import pii_bootstrap as m

    found = {r["text"]: r["spans"] for r in m.find(contexts).join(contexts.select("doc_id", "text"), "doc_id").collect()}
    text_of = lambda t: {(m.KINDS[s["kind"]], t[s["start"] : s["stop"]]) for s in found[t] if s["kind"] >= 4}
    for t in filter(None, found):
        for number in re.findall(r"(?:call|line) (0\d+/\d+)", t):
            assert ("ctx_phone", number) in text_of(t), t
        assert "order number" not in t or not text_of(t)
        assert "localhost" not in t or text_of(t) == {("ctx_email", "someone@localhost")}


def test_base_spans_of_hard_texts():
    from terraloom.llm import pii_bootstrap as m

    rng = random.Random(12)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "23", "255", "256", "0", ".", "-", " ", "+", "@", "a", "b.c", "x", "(", ")", "%", "\n", "é", "4111111111111111"]) for _ in range(rng.randrange(1, 40)))
        assert m.base_spans(text) == base_brute(text), text
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" + " " * 300_000, "1 " * 150_000 + "x", "@" * 200_000, "x" * 100_000 + "5" * 9):
        m.sites_of(text)  # in time that grows with the text


def test_short_items_stand_alone_and_ids_keep_their_type(spark):
    from terraloom.llm import decontam

    texts = ["nothing here", "there is no way", "No", "a casino", None, "", "it is 42.", "in 1942 or 420"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([("n", "no"), ("f", "42"), ("long", "an item of some twenty letters")], "item_id string, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.query(docs, items).collect()}
    assert got == {0: [], 1: ["n"], 2: ["n"], 3: [], 4: [], 5: [], 6: ["f"], 7: []}
    assert [r["doc_id"] for r in decontam.decontaminate(docs, items).orderBy("doc_id").collect()] == [0, 3, 4, 5, 7]
