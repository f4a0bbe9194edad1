"""The divergence audit, window packing and vector codes against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from caliper.llm import divergence_audit as DA
from caliper.llm import queries as Q
from caliper.llm import vector_codes as VC
from caliper.llm import window_packing as WP

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- divergence audit

def plain_audit(docs, least, top=10):
    """All rows of the audit from (text, lang, source), term by term."""
    n, df, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        n.update((lang, source, t) for t in found)
        df.update({(lang, t) for t in found})
    out = set()
    for lang, sources in groups.items():
        kept = [t for (g, t), c in df.items() if g == lang and c >= least]
        total = {t: sum(n[lang, s, t] for s in sources) for t in kept}

        def p(count, whole):
            return 1 + 10**9 * (count + 2) // (whole + 2 * len(kept))

        whole = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        prob = {s: {t: p(n[lang, s, t], whole[s]) for t in kept} for s in sources}
        q = {t: p(total[t], sum(whole.values())) for t in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            parts = {"pair": [(sum(f(prob[s][t], prob[o][t]) for t in kept), o) for o in sources if o != s],
                     "term": [(f(prob[s][t], q[t]), t) for t in kept if n[lang, s, t] and prob[s][t] > q[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top}
    return out


def random_documents(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "Straße", "ÉTÉ", "été", "x", "don't", "a1b", "漢字", "zz_top", "ZZ"] + [f"w{chr(97 + i)}" for i in range(26)]
    docs = [(" ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s10", "é", None])) for _ in range(n)]
    return docs + docs[:10] + [(None, "en", "quiet"), ("", "fr", "alone"), ("one two", "it", "a"), ("!!", "it", "b"), ("one", "it", "c")]


def as_frame(spark, docs):
    return spark.createDataFrame([(i, *d, "x", 1.0, None) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term string, n double, entries int").repartition(4)


def test_audit_equals_term_by_term_sums(spark):
    docs = random_documents(1)
    got = [tuple(r) for r in DA.audit(as_frame(spark, docs), least_docs=4, top=3).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    want = plain_audit(docs, 4, 3)
    assert set(got) == want
    assert any(v == 0 for lang, _, part, _, v, _ in want if lang == "it" and part == "pair")


def test_audit_of_an_empty_table_and_of_one_group(spark):
    empty = as_frame(spark, [("a", "b", "c")]).where("false")
    assert DA.audit(empty).count() == 0
    one = DA.audit(as_frame(spark, [("a b", "en", "s")] * 10))
    assert one.count() == 0  # no other source, and no term likelier than in its language


@pytest.mark.parametrize("wide", [2, 5, 1024])
def test_products_hold_every_joint_table(monkeypatch, wide):
    monkeypatch.setattr(DA, "WIDE", wide)
    rng = np.random.default_rng(3)
    term, group, count = [], [], []
    for t in range(40):
        for g in np.flatnonzero(rng.random(6) < 0.7):
            term.append(t), group.append(g), count.append(rng.integers(1, 4))
    got = Counter()
    for part in DA.level_products(np.array(term), np.array(group), np.array(count)):
        for *key, n in zip(*(p.tolist() for p in part)):
            got[tuple(key)] += n
    want = Counter()
    for i in range(len(term)):
        for j in range(len(term)):
            if term[i] == term[j] and group[i] < group[j]:
                want[group[i], count[i], group[j], count[j]] += 1
    assert got == want


def test_long_texts_are_cut_where_terms_end(spark, monkeypatch):
    text = ("word " * 50 + "longer" * 30 + " é, X") * 20
    assert b"".join(DA._pieces(text.encode())) == text.encode()
    monkeypatch.setattr(DA, "_PIECE", 64)
    assert [w for p in DA._pieces(text.encode()) for w in p.translate(DA._TERMS).split()] == text.encode().translate(DA._TERMS).split()
    huge = "alpha beta " * 600_000  # 6.6 MB in one text
    rows = {r["term"]: (r["n"], r["docs"]) for r in DA.term_counts(as_frame(spark, [(huge, "en", "s"), ("alpha", "en", "s")])).collect()}
    assert rows == {None: (0, 0), "alpha": (600_001, 2), "beta": (600_000, 1)}


# ---------------------------------------------------------------- window packing

def plain_differencing(sizes, k):
    """The method on lists of (sum, pieces): falling slots of one meet rising slots of the other."""
    parts = [[(s, [i])] + [(0, [])] * (k - 1) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: -(p[0][0] - p[-1][0]))
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda s: -s[0]))
    return parts[0]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_differencing_is_as_even_as_the_plain_method(k):
    rng = np.random.default_rng(k)
    for n in (1, 4, 9, 30):
        sizes = rng.choice(10_000, n, replace=False) + 1
        window = WP.differencing(sizes, k)
        sums = np.bincount(window, sizes, minlength=k)
        want = [s for s, _ in plain_differencing(sizes.tolist(), k)]
        assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 2 * max(1, max(want) - min(want))
        if n > 6 * k:
            assert sums.max() - sums.min() < sizes.max() / 4


def merged_one_by_one(sizes, k):
    """Differencing with a merge a step; of equal sums the first partition's come first."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    turn = len(sizes)
    while len(heap) > 1:
        heap.sort()
        (_, _, a), (_, _, b), *heap = heap
        over = max(0, len(a) + len(b) - k)
        met = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - over :], b[::-1])]
        slots = sorted(a[: len(a) - over] + met + b[: len(b) - over], key=lambda s: -s[0])
        heap.append((-(slots[0][0] - (slots[-1][0] if len(slots) == k else 0)), turn, slots))
        turn += 1
    return [at for i in range(len(sizes)) for at, (_, own) in enumerate(heap[0][2]) if i in own]


def test_merges_at_a_time_are_merges_one_by_one(monkeypatch):
    rng = np.random.default_rng(11)
    sizes = [rng.integers(1, high + 1, rng.integers(1, 70)) for high in (1, 3, 9, 50, 1024) for _ in range(12)]
    for own in sizes:
        for k in (2, 5, 17, 40):
            assert WP.differencing(own, k).tolist() == merged_one_by_one(own.tolist(), k)
    sorts = []
    monkeypatch.setattr(WP.np, "argsort", lambda x, kind, own=np.argsort: sorts.append(len(x)) or own(x, kind=kind))
    WP.differencing(np.arange(1000, 0, -1), 300)
    assert len(sorts) < 50  # 999 when every merge was sorted


def test_known_partition():
    sums = np.bincount(WP.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]  # what differencing gives for this textbook case


def test_window_count_rises_and_pieces_are_cut_for_little_padding():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 1024, 900), np.full(700, 700), rng.integers(1, 60, 3000), np.array([1000, 900, 3])):
        piece, start, length, window = WP.windows_of(sizes, 1024)
        filled = np.bincount(window, length)
        least = -(-sizes.sum() // 1024)
        assert filled.max() <= 1024 and np.array_equal(np.bincount(piece, length), sizes)
        assert (filled > 0).sum() <= least + max(2, least // WP.SPARE)


ODD = ["", None, "a", "<|endoftext|>", "x<|endoftext|> y", "  two  spaces\n\n", "naïve 漢字 🎉", "z" * 5000, "tab\tnew\x85line\x1c", "don't 'll", " " * 3000, "plain words " * 3000]


def test_windows_hold_every_id_once(spark, table):
    library = Tokenizer.from_file(BYTE_BPE)
    texts = ODD * 3 + ["some words " * n for n in range(60)]
    ids = list(range(len(texts) - 1)) + [None]
    docs = table(texts, ids=ids, lang=["x"] * len(texts))
    rows = WP.pieces(WP.pack(docs, BYTE_BPE, 0)).collect()
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in zip(ids, texts)}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(want[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_window[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(by_doc[i], len(w)) for i, w in want.items()] + [(v, None) for v in by_window.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == total if total else at <= 1024
    assert by_doc.keys() == want.keys()
    assert len(by_window) <= sum(map(len, want.values())) / 1024 * 1.01 + 2 * docs.rdd.getNumPartitions()


def test_packing_repeated_ids_and_an_empty_table(table):
    same = WP.pieces(WP.pack(table(["a b", "a b", "c"], ids=[1, 1, 1]), BYTE_BPE, 0))
    assert sorted((r.doc_id, r.start, r.length) for r in same.collect()) == [(1, 0, 2), (1, 0, 3), (1, 0, 3)]
    assert WP.pack(table(["a"]).where("false"), BYTE_BPE, 0).count() == 0


def test_quick_ids_are_the_library_s():
    own, library, rng = WP.Encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE), random.Random(5)
    assert own.quick is not None
    letters = "aZ9 \t\n\r\x0b\x1c\x85　'srévdl漢字🎉́_-.,​\x00ſ²Ⅷ٣ª "
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert own.encode(text, False).tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)
    assert WP.Encoder(public_tokenizers.path("word_bpe_49k.json")).quick is None


# ---------------------------------------------------------------- vector codes

def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted((r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.array([[int(np.floor(np.float64(np.float32(c)) * 4096)) for c in v] for _, v, _ in rows], object)
    width = x.shape[1] // parts
    cut = [x[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [[list(row) for row in c[:entries]] for c in cut]

    def nearest(p, row):
        return min((sum((a - b) ** 2 for a, b in zip(row, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            found = [nearest(p, row)[1] for row in cut[p]]
            for e in range(len(books[p])):
                own = [row for row, f in zip(cut[p], found) if f == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    told = [[nearest(p, cut[p][i]) for p in range(parts)] for i in range(len(rows))]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    sums = Counter()
    for (_, _, label), t in zip(rows, told):
        sums[label] += sum(d for d, _ in t)
    return sorted((str(i), "".join(f"{e:02x}" for _, e in t), sum(d for d, _ in t), sums[label], sha) for (i, _, label), t in zip(rows, told))


def vectors(seed, n, width=16, close=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, width))
    rows = [(i, [float(c) for c in np.float32(centres[i % 5] + rng.normal(0, 0.02 if close else 0.2, width))], [None, 1, 2][i % 3]) for i in range(n)]
    return rows


@pytest.mark.parametrize("rows", [vectors(1, 150), vectors(2, 90, close=True), vectors(3, 7), vectors(4, 40) + vectors(4, 40)[:9] + [(None, [0.25] * 16, 1), (99, [0.0] * 16, None)],
                                  [(i, [float(i % 2)] * 16, 1) for i in range(40)]])
def test_codes_equal_plain_rounds(spark, tmp_dir, rows):
    bad = [(500, None, 1), (501, [0.1] * 15 + [None], 1), (502, [float("nan")] * 16, 1), (503, [float("-inf")] + [0.0] * 15, None)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    frame.write.mode("overwrite").parquet(f"{tmp_dir}/embeddings.parquet")
    got = Q.op13_vector_codes(spark, tmp_dir)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == plain_codes(rows)


def test_codes_of_an_empty_table_and_of_too_large_components(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert VC.compress(spark.createDataFrame([], schema))[0].count() == 0
    assert VC.compress(spark.createDataFrame([(1, None, 1)], schema))[0].count() == 0
    with pytest.raises(Exception, match="beyond"):
        VC.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], schema))


def test_net_moves_spare_scans_and_are_no_more_than_drifts():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(-3000, 3000, (1, 8)) + rng.integers(-300, 300, (200, 8)) for _ in range(16)]).astype(np.int64)
    x = x[rng.permutation(len(x))]
    books = VC.Codebooks([0, 8], [[x[:16].copy()]])
    code, upper, lower, stamps = np.zeros(len(x), np.uint8), np.zeros(len(x)), np.zeros(len(x)), np.zeros((len(x), 2), np.uint8)
    scanned = []
    for now in range(8):
        moves = VC.net_moves(books) if now else None
        scanned.append(VC.assign_part(x, books.history[-1][0], now, code, upper, lower, stamps, moves and moves[0]))
        d = ((x[:, None] - books.history[-1][0][None]) ** 2).sum(2)
        assert np.array_equal(code, d.argmin(1))
        books.history.append([np.array([x[code == e].sum(0) // max(1, (code == e).sum()) if (code == e).any() else books.history[-1][0][e] for e in range(16)])])
    assert scanned[0] == len(x) and scanned[-1] < len(x) / 4
    net = VC.net_moves(books)[0][0]
    steps = [np.sqrt(((b[0] - a[0]) ** 2).sum(1)) for a, b in zip(books.history, books.history[1:])]
    for s in range(len(books.history)):
        drift = sum(steps[s:], np.zeros(16))
        assert (net[s] <= drift * (1 + 1e-6) + 1e-6).all()
    assert (net[0] < sum(steps) - 1).any()


# ---------------------------------------------------------------- the registered queries

def test_queries_on_a_small_folder(spark, tmp_dir):
    docs = random_documents(9, 200)
    as_frame(spark, docs).write.parquet(f"{tmp_dir}/documents.parquet")
    got = Q.op11_divergence_audit(spark, tmp_dir)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert {tuple(r) for r in got.collect()} == plain_audit(docs, 10)
    library = Tokenizer.from_file(BYTE_BPE)
    for r in Q.op12_window_packing(spark, tmp_dir).collect():
        ids = library.encode(docs[r.doc_id][0] or "", add_special_tokens=False).ids + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)


def test_texts_of_single_white_space_need_no_look_ahead():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = WP.Encoder(path)
    rng = random.Random(12)
    pieces = ["a", "don't", "'ll", "7", "x9", "é", "日本", "!?", "_", "…", "٣", "½"]
    spaces = [" ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000"]
    texts = ["", " ", "\n", " a", "a ", "\na\n", "a  b", "a \nb", "a\u3000\u2003b", "a\xa0 b", " \x85"]
    texts += ["".join(rng.choice(pieces) + (rng.choice(spaces) if rng.random() < 0.5 else "") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts += ["".join(rng.choice(pieces + spaces) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    several = pc.match_substring_regex(pa.array(texts), WP.SPACE * 2).to_pylist()
    assert 0 < sum(several) < len(texts)
    for text, spaced in zip(texts, several):
        assert own.encode(text, False, spaced).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert "(?!" in own.quick._pat_str and "(?!" not in own.single._pat_str
