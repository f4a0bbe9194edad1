"""Near-duplicates, decontamination, archives and the pipeline against brute force."""

import base64
import gzip
import hashlib
import io
import itertools
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from caliper.llm import decontaminate, hashing, minmax_dedup, queries, store, zip_warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in WORDS.findall(text or "")]


def prose(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def edited(rng, base, k):
    out = list(base)
    for _ in range(k):
        out[rng.randrange(len(out))] = "zz" + str(rng.randrange(10**6))
    return out


def grouped(texts, ids, k):
    """Components by comparing all pairs."""
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sets, {i: root(i) for i in sets}


def copies(seed):
    rng = random.Random(seed)
    texts = [" ".join(prose(rng, rng.randint(20, 150))) for _ in range(40)]
    for size in (2, 6, 60):
        base = prose(rng, 110)
        texts += [" ".join(edited(rng, base, rng.randint(0, 6))) for _ in range(size)]  # around the threshold
    shared = prose(rng, 60)  # a passage in many texts that aren't copies
    texts += [" ".join(prose(rng, 40) + shared) for _ in range(40)]
    texts += ["Same Text here\tfor all", "same text HERE\n for all"] * 8 + ["a b", "a  b", "a b c", "", " ", None, "one"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_all_pairs(spark, table, k):
    texts = copies(k)
    ids = [7 * i - 50 for i in range(len(texts))]
    docs = table(texts, ids).withColumn("digest", F.lit(1)).withColumn("node", F.lit(1)).withColumn("component", F.lit(1))
    sets, want = grouped(texts, ids, k)
    got = minmax_dedup.near_duplicates(docs, k=k).collect()
    assert len(got) == len(texts)
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_chains_and_stragglers_are_found(spark, table):
    """Texts that link to neighbours only, far beyond a hub's reach."""
    rng = random.Random(9)
    line = prose(rng, 400)
    texts = [" ".join(line[4 * i : 4 * i + 100]) for i in range(60)] + [" ".join(line[4 * i + 2 : 4 * i + 98]) for i in range(0, 60, 7)]
    rng.shuffle(texts)
    _, want = grouped(texts, range(len(texts)), 4)
    got = {r["doc_id"]: r["component_id"] for r in minmax_dedup.near_duplicates(table(texts), k=4).collect()}
    assert got == want


def _meets(x, y, hub):
    """How many traces two sets share where one asks and the other can be found."""
    sides = [{kind: (asks, set(found.tolist())) for kind, asks, found in minmax_dedup.traces_of(s, hub)[1]} for s in (x, y)]

    def seen(asking, found):
        n = 0
        for kind, (asks, own) in asking.items():
            if asks and kind in found and (kind == minmax_dedup.SAME or found[kind][0] == (kind == minmax_dedup.FAR)):
                n += len(own & found[kind][1])
        return n

    return max(seen(*sides), seen(*reversed(sides)))


@pytest.mark.parametrize("n", [40, 300, 1500, 6000])
def test_links_beside_the_hub_share_traces(n):
    """Sets that link with each other but not both with the hub, whatever way they differ."""
    rng = np.random.default_rng(n)

    def linked(a, b):
        both = len(np.intersect1d(a, b))
        return 100 * both >= 80 * (len(a) + len(b) - both)

    def changed(s, lose, gain):
        keep = s[rng.random(len(s)) >= lose]
        return np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(gain * len(s)), np.uint64)]))

    hub = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
    seen, fewest = 0, 10**9
    for _ in range(300):
        x = changed(hub, rng.uniform(0, 0.6), rng.uniform(0, 0.6))
        y = changed(x, rng.uniform(0, 0.15), rng.uniform(0, 0.12))
        if rng.random() < 0.3:  # back towards the hub, so that one of the two may link with it
            y = np.unique(np.concatenate([y, rng.choice(hub, int(0.1 * n), replace=False)]))
        if linked(x, y) and not (linked(x, hub) and linked(y, hub)) and len(np.intersect1d(y, hub)):
            seen += 1
            fewest = min(fewest, _meets(x, y, hub))
    assert seen > 50 and fewest >= 1


def test_outlines_bound_what_differences_share():
    rng = np.random.default_rng(2)
    for d in (5, 200, 2000):
        a, b = (rng.integers(0, 1 << 63, d, np.uint64) for _ in range(2))
        b[: d // 3] = a[: d // 3]
        alone = int(np.bitwise_count(minmax_dedup.outline(a).view(np.uint64) & ~minmax_dedup.outline(b).view(np.uint64)).sum())
        assert d // 3 <= d - alone <= d


def test_a_hub_with_many_unlinked_neighbours_is_not_paired_with_itself(spark, table, monkeypatch):
    """Rows joined by traces grow with the neighbours, not with their square."""
    joined = []
    pairs = minmax_dedup._pairs
    monkeypatch.setattr(minmax_dedup, "_pairs", lambda met, name: (joined.append(met.count()), pairs(met, name))[1])
    counts = {}
    for size in (200, 1000):
        rng = random.Random(4)
        base = prose(rng, 300)
        texts = [" ".join(base)] + [" ".join(rng.choice(prose(rng, 3)) if rng.random() < 0.08 else w for w in base) for _ in range(size)]
        joined.clear()
        got = minmax_dedup.near_duplicates(table(texts), k=4)
        assert got.where("not kept").count() < size / 4
        counts[size] = sum(joined)
    assert counts[1000] <= 8 * counts[200] + 2000, counts


def test_null_and_repeated_ids(spark, table):
    text = "one two three four five six"
    docs = table([text, text, text, "other words that stand here alone", None], [3, 3, None, 9, None])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minmax_dedup.near_duplicates(docs, k=4).collect()), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (None, None, True), (9, 9, True), (None, None, True)], key=str)
    assert minmax_dedup.near_duplicates(docs.limit(0), k=4).count() == 0


def test_min_max_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 1500).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[300:1300])
    s = minmax_dedup.signature([a, b], 512)
    assert abs((s[0] == s[1]).mean() - 700 / 1300) < 0.06
    keys = minmax_dedup.band_keys(s, 4)
    assert keys.shape == (2, 256) and len(set(keys[0].tolist())) == 256


def test_word_hashes_see_words_only():
    texts = ["A b\tC", "a B c ", "", "\n", "ab c", "é É", "x" * 50]
    column = queries.F and __import__("pyarrow").array(texts)
    h, at = hashing.word_hashes(*hashing.texts_buffer(column))
    per = [h[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
    assert per[0] == per[1] and per[2] == per[3] == [] and len(per[4]) == 2 and per[5][0] != per[5][1] and len({tuple(p) for p in per}) == 5
    old, hashing._PIECE = hashing._PIECE, 3
    try:
        assert np.array_equal(hashing.word_hashes(*hashing.texts_buffer(column))[0], h)
    finally:
        hashing._PIECE = old


def test_masks_hit_every_window_with_two_substitutions():
    n = decontaminate.WINDOW
    for a, b in itertools.combinations(range(n), 2):
        same = np.arange(n, dtype=np.uint64)
        other = same.copy()
        other[[a, b]] += np.uint64(1000)
        assert any(np.intersect1d(x, y).size for (x, _), (y, _) in zip(decontaminate.seeds(same), decontaminate.seeds(other)))


def overlapping(texts, items):
    """Pairs by comparing every shift."""
    out = set()
    for d, i in itertools.product(texts, items):
        w, x = words(texts[d]), words(items[i])
        if len(x) < 6:
            if x and x == w:
                out.add((d, i))
            continue
        width, slack = (12, 2) if len(x) >= 12 else (len(x), 1)
        for shift in range(-len(x), len(w)):
            a, b = max(0, -shift), min(len(x), len(w) - shift)
            same = [x[k] == w[k + shift] for k in range(a, b)]
            if any(sum(same[k : k + width]) >= width - slack for k in range(len(same) - width + 1)):
                out.add((d, i))
                break
    return out


def test_overlaps_equal_brute_force(spark, table):
    rng = random.Random(10)
    items = {i: " ".join(prose(rng, rng.choice([3, 6, 9, 12, 30, 60]))) for i in range(30)} | {30: None, 31: ""}
    items[32] = items[4]
    texts = {}
    for d in range(80):
        item = words(items[rng.randrange(30)])
        cut = rng.randint(0, max(0, len(item) - 12))
        part = edited(rng, item[cut : cut + rng.randint(8, 60)] or ["x"], rng.choice([0, 0, 1, 2, 4]))
        texts[d] = " ".join(prose(rng, rng.randint(0, 30)) + (part if d % 2 else []) + prose(rng, rng.randint(0, 30))).upper() if d % 3 else " ".join(prose(rng, 5) + part)
    texts |= {80: None, 81: "", 82: " ".join(prose(rng, 5000)) + " " + (items[5] or "")}
    docs = table(list(texts.values()), list(texts)).withColumn("item", F.lit(1)).withColumn("hash", F.lit(1))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = decontaminate.overlaps(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == overlapping(texts, items)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    for r in got:
        w, x = words(texts[r["doc_id"]]), words(items[r["item_id"]])
        assert r["matched"] <= r["spanned"] and sum(a in x for a in w[r["first_word"] : r["first_word"] + r["spanned"]]) >= r["matched"]


def test_overlaps_of_nothing(spark, table):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    docs = table(["a b c d e f g h", "a b c d e f g h", None], [None, 4, 5])
    assert [r["doc_id"] for r in decontaminate.overlaps(docs, bench).collect()] == [4]
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0 and decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def pages(spark):
    rng = random.Random(11)
    html = [rng.choice([None, "", "<p>same</p>", "é" * 50, f"<p>{i}</p>" * rng.randint(1, 400)]) for i in range(120)] + ["<p>same</p>", "<p>same</p>", "x" * 300_000]
    ids = [*rng.sample(range(-20, 400), 120), 777, 777, None]
    urls = [rng.choice([None, "http://a/\r\nX: y", f"http://h/{i}"]) for i in range(123)]
    return list(zip(ids, urls, html, strict=True))


def test_archives_round_trip(spark):
    rows = pages(spark)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("same", F.lit(1)).repartition(4)
    folder = store.new_folder(spark, "test-warc")
    listed = zip_warc.write(df, folder)
    got = zip_warc.read(listed, folder).collect()
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        head = first.get(html or "", page)
        revisit = page != head
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", head if revisit else None, b"" if revisit else body))
    assert sorted(map(repr, want)) == sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]))) for r in got)


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    folder = store.new_folder(spark, "test-warc")
    got = {r["page_id"]: r["refers_to"] for r in zip_warc.read(zip_warc.write(df, folder, least=3), folder).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    empty = store.new_folder(spark, "test-warc")
    assert zip_warc.read(zip_warc.write(df.limit(0), empty), empty).count() == 0


def reader(data):
    return zip_warc.Reader(lambda n, at: data[at : at + n], len(data))


def test_directories_plain_and_wide():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment with PK\x05\x06 in it, and more than twenty-two bytes"
        z.writestr("first", b"11")
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"22" * 100)
        z.writestr("näme", b"3", zipfile.ZIP_DEFLATED)
    r = reader(out.getvalue())
    assert list(r.members) == ["first", "wide", "näme"]
    at, n = r.stored("wide")
    assert out.getvalue()[at : at + n] == b"22" * 100
    with pytest.raises(ValueError, match="stored"):
        r.stored("näme")
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(65_600):  # more than a plain end record can count
            z.writestr(f"{i}", b"")
        z.writestr("last", b"here")
    r = reader(many.getvalue())
    at, n = r.stored("last")
    assert len(r.members) == 65_601 and many.getvalue()[at : at + n] == b"here"
    with pytest.raises(ValueError, match="not a ZIP"):
        reader(b"nothing")


def test_zip64_offsets():
    """Full 32-bit fields are taken from the ZIP64 field, in order and only where full."""
    wide = zip_warc.Reader._wide
    extra = b"\x55\x55\x02\x00xx" + b"\x01\x00\x10\x00" + (5 << 32).to_bytes(8, "little") + (7 << 32).to_bytes(8, "little")
    assert wide(extra, zip_warc.FULL32, 12, zip_warc.FULL32) == (5 << 32, 12, 7 << 32) and wide(b"", 1, 2, 3) == (1, 2, 3)


def test_records_are_gzip_members():
    out = io.BytesIO()
    package = zip_warc.Package(out)
    package.add(1, "http://a/", b"payload", None)
    package.add(2, None, b"payload", 1)
    package.close()
    r = reader(out.getvalue())
    at, n = r.stored(zip_warc.ARCHIVE)
    assert gzip.decompress(out.getvalue()[at : at + n]).count(b"WARC/1.1\r\n") == 2
    rows = list(r.records())
    assert [(x["page_id"], x["record_type"], x["refers_to"], x["payload_bytes"]) for x in rows] == [(1, "response", None, 7), (2, "revisit", 1, 7)]
    with pytest.raises(ValueError, match="digest"):
        zip_warc.parse(zip_warc.record(1, None, b"payload", None).replace(b"payload\r\n", b"pAyload\r\n"))


def test_short_items_of_a_benchmark(spark, table):
    """Six to eleven words with one substitution; fewer only as a whole text."""
    rng = random.Random(3)
    six, nine, eleven = (prose(rng, n) for n in (6, 9, 11))

    def other(words, *places):
        return ["zzz" if i in places else w for i, w in enumerate(words)]

    texts = [" ".join(prose(rng, 30) + w + prose(rng, 30)) for w in (
        six, other(six, 2), other(six, 0), other(six, 1, 4), six[:4], nine, other(nine, 4), other(nine, 0, 8), other(eleven, 5), other(eleven, 5, 6))]
    texts += ["Two words", "two  words\n", "two words more", "words two", "one", "", None]
    bench = spark.createDataFrame(list(enumerate([" ".join(w) for w in (six, nine, eleven)] + ["two words", "one", "", None])), "item_id int, text string")
    got = {(r["doc_id"], r["item_id"], r["matched"], r["spanned"]) for r in decontaminate.overlaps(table(texts), bench).collect()}
    assert got == {(0, 0, 6, 6), (1, 0, 5, 6), (2, 0, 5, 6), (5, 1, 9, 9), (6, 1, 8, 9), (8, 2, 10, 11), (10, 3, 2, 2), (11, 3, 2, 2), (14, 4, 1, 1)}


def test_pipeline_stages(spark, tmp_dir):
    import corpus_pipeline
    from caliper.llm import secret_grammar

    rng = random.Random(12)
    speech = {n: prose(random.Random(n), 60) for n in ("xx", "yy")}
    rows = []
    for i in range(160):
        lang = rng.choice(["xx", "yy"])
        rows.append([i, " ".join(rng.choice(speech[lang]) for _ in range(80)), lang, "s", 0])
    bench = [(1, " ".join(prose(rng, 30)))]
    rows[5][1] += " " + bench[0][1]
    rows[7][1] = rows[6][1] + " more"
    rows[9][1] += " password=abcdef0123456789"
    rows[11][1] = "12 34"
    rows[12][1], rows[12][0] = None, None
    for r in rows:
        r[4] = len(r[1] or "")
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    gone = [{11, None}, {7}, {5}, set()]
    left = {r[0] for r in rows}
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:4], gone, strict=True):
        docs = store.written(stage(spark, docs, tmp_dir), "test-pipeline")
        left -= lost
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == left, name
    assert not any(secret_grammar.base_spans(r["text"]) for r in docs.collect())
    last = corpus_pipeline.run(spark, tmp_dir)
    assert {r["doc_id"] for r in last.collect()} == left and last.columns == ["doc_id", "n_tokens", "ids", "decoded"]


def _stage_folder(spark, folder, rows, bench):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_judges_rows_not_ids(spark, tmp_dir):
    import corpus_pipeline

    rng = random.Random(31)
    a, b, c, d, item, tail = (" ".join(prose(rng, 60)) for _ in range(6))
    rows = [(1, a), (3, a), (3, b), (5, c), (5, c), (None, a), (None, d), (7, d + " " + item), (7, b + " " + tail), (9, None), (9, "")]
    docs = _stage_folder(spark, tmp_dir, [(i, t, "x", "s", len(t or "")) for i, t in rows], [(1, item)])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, tmp_dir)
    left = [(1, a), (3, b), (5, c), (7, rows[7][1]), (7, rows[8][1]), (9, None), (9, ""), (None, d)]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(str((i, len(t or ""))) for i, t in got) == sorted(str((i, len(t or ""))) for i, t in left)
    assert sorted(got, key=str) == sorted(left, key=str) and kept.columns == list(corpus_pipeline.COLUMNS)
    clean = corpus_pipeline.drop_contaminated(spark, store.written(kept, "test-pipeline"), tmp_dir)
    left.remove((7, rows[7][1]))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(left, key=str)


def test_pipeline_of_an_empty_table(spark, tmp_dir):
    import corpus_pipeline

    _stage_folder(spark, tmp_dir, [(1, "a", "x", "s", 1)], [(1, "b")]).where("false").write.parquet(f"{tmp_dir}/none/documents.parquet")
    spark.read.parquet(f"{tmp_dir}/benchmark.parquet").write.parquet(f"{tmp_dir}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_dir}/none").count() == 0


def test_row_keys_follow_the_ids(spark):
    df = spark.createDataFrame([(i, str(i)) for i in (5, 3, 9)], "doc_id long, text string").repartition(2)
    assert {r.key: r.doc_id for r in store.row_keys(df, "doc_id", "key").collect()} == {5: 5, 3: 3, 9: 9}
    df = spark.createDataFrame([(i, "t") for i in [4] * 50 + [None] * 30 + [2, -1]], "doc_id long, text string").repartition(6)
    rows = store.row_keys(df, "doc_id", "key").collect()
    assert len({r.key for r in rows}) == 82
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.key)] == [-1, 2] + [4] * 50 + [None] * 30
