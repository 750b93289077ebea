"""The operators against brute force, exact round trips and held-out labels, and on odd inputs."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import binary, chat, decontaminate, html, jaccard, language, packing, quality, queries, suffix_dedup, tokens, url_filters
from brindle.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        c.sql(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    r = c.sql(queries.oracle_sql()[name])
    assert sorted(r.columns) == sorted(df.columns)
    assert rows(df, *r.columns) == sorted(r.fetchall(), key=str)


# 1


def test_url_filter_edges(spark):
    lists = spark.createDataFrame([("l", "block", "Bad.org", "add", "2024-01-01"), ("l", "block", "bad.org", "remove", "2024-02-01"), ("l", "block", "bad.org/x/", "add", "2024-03-01"), ("l", "block", "same.org", "add", "2024-01-01"), ("l", "block", "same.org", "remove", "2024-01-01")], url_filters.LIST_SCHEMA)
    captures = [
        (1, "http://a.bad.org/", "2024-01-01"), (2, "http://a.BAD.org:80/q", "2024-01-31"), (3, "http://bad.org/", "2024-02-01"), (4, "http://bad.org/x/y?z", "2024-03-01"), (5, "http://a.bad.org/x", "2024-03-01"),
        (6, "http://notbad.org/", "2024-01-05"), (7, None, "2024-01-05"), (8, "", "2024-01-05"), (9, "http://bad.org/", None), (10, "http://same.org/", "2024-01-05"), (2, "http://a.BAD.org:80/q", "2024-01-31"), (11, "http://bad.org/xy", "2024-03-02"),
    ]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at")).withColumn("key", F.lit(1))
    got = Counter((r["page_id"], r["kept"]) for r in url_filters.filter_urls(df, lists).collect())
    assert got == Counter([(1, False), (2, False), (2, False), (3, True), (4, False), (5, True), (6, True), (7, True), (8, True), (9, True), (10, True), (11, True)])
    assert url_filters.filter_urls(df, lists.limit(0)).filter("kept").count() == len(captures)
    assert url_filters.filter_urls(df.limit(0), lists).count() == 0


# 2


def distance(item, text):
    col = list(range(len(item) + 1))
    best = col[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(col[i] + 1, new[i - 1] + 1, col[i - 1] + (p != c)))
        col, best = new, min(best, new[-1])
    return best


def test_decontamination_finds_edited_copies(spark, odd_docs, no_docs):
    rnd = random.Random(1)
    items = [(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))) for i, n in enumerate((8, 12, 20, 35, 60, 90, 5))] + [(7, None), (8, "")]
    docs, planted = [], set()
    for i, t in items[:6]:
        for rate in (0, 0.1):
            w = t.split()
            for _ in range(int(len(w) * rate)):
                w[rnd.randrange(len(w))] = "zzz"
            docs.append((100 + len(docs), " ".join([f"x{rnd.randrange(999)}" for _ in range(rnd.randrange(40))] + w + ["end"] * rnd.randrange(9))))
            planted.add((docs[-1][0], i))
    docs += [(900, "a " + items[6][1])]  # short items count too
    planted.add((900, 6))
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted
    texts = dict(docs)
    assert all(distance(dict(items)[r["item_id"]].split(), texts[r["doc_id"]].split()) == r["edits"] for r in got)
    assert decontaminate.contaminated(no_docs, bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_loses_no_copy_at_the_edit_limit(spark):
    rnd = random.Random(2)
    word = lambda: f"w{rnd.randrange(50_000)}"
    items, docs = {}, {}
    for n in (8, 10, 12, 15, 20, 28, 30, 45, 60):
        for edits in {0, n // 5}:
            for _ in range(40):
                k = len(items)
                items[k] = [word() for _ in range(n)]
                w = list(items[k])
                for _ in range(edits):  # the copy's edits, at most a fifth of its words
                    at, what = rnd.randrange(len(w)), rnd.randrange(3)
                    w[at : at + (what > 0)] = [word()] if what < 2 else []
                docs[k] = [word() for _ in range(rnd.randrange(9))] + w + [word() for _ in range(rnd.randrange(9))]
    # a hundred rows have no copy, and words in common with an item
    docs |= {1000 + k: [word() for _ in range(30)] + items[k][:3] + [word() for _ in range(30)] for k in range(100)}
    frame = lambda x, key: spark.createDataFrame([(k, " ".join(w)) for k, w in x.items()], f"{key} long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == {(k, k): distance(items[k], docs[k]) for k in items}


@pytest.mark.parametrize("percent", [0, 10, 20])
def test_decontamination_recall_by_length(percent):
    rnd = random.Random(percent)
    word = lambda: f"w{rnd.randrange(200_000)}"
    sizes = [*range(1, 21), *range(24, 60, 5), 75, 100, 125, 150]
    items = [[word() for _ in range(n)] for n in sizes for _ in range(40)]
    index = decontaminate.Items(list(range(len(items))), [" ".join(w).encode() for w in items])
    copies = []
    for w in items:
        w = list(w)
        for _ in range(len(w) * percent // 100):
            at, what = rnd.randrange(len(w)), rnd.randrange(3)
            w[at : at + (what > 0)] = [word()] if what < 2 else []
        copies.append(" ".join([word() for _ in range(rnd.randrange(9))] + w + [word() for _ in range(rnd.randrange(9))]).encode())
    hashes, first, _, _ = decontaminate.words(copies)
    near = {(d, i) for d, i, lo, hi in index.spans(hashes, first) if index.distance(i, hashes[lo:hi].tolist())[0] <= index.allowed[i]}
    lost = Counter(len(items[k]) for k in range(len(items)) if (k, k) not in near)
    assert max(lost.values(), default=0) <= 2  # of 40: at least 0.95 for every length
    assert sum(lost.values()) <= 0.002 * len(items)


def test_decontamination_in_blocks_equals_one_block_and_brute_force(spark, monkeypatch):
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = rows(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "start", "edits")
    low = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    texts = {r["doc_id"]: WORD.findall(low(r["text"])) for r in docs.collect()}
    items = {r["item_id"]: WORD.findall(low(r["text"])) for r in bench.collect()}
    some = dict(sorted(items.items())[:8])
    brute = sorted((d, i, distance(w, t)) for d, t in texts.items() for i, w in some.items() if distance(w, t) <= len(w) // 5)
    assert sorted((d, i, e) for d, i, _, e in whole if i in some) == brute
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    assert rows(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "start", "edits") == whole


def test_decontamination_of_a_copy_without_its_head_after_empty_rows(spark):
    item = [f"w{k}" for k in range(20)]
    docs = [(1, "x " * 50), (2, None), (3, ""), (4, "y"), (5, " ".join(item[4:] + ["end"] * 30))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = decontaminate.contaminated(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert rows(got, "doc_id", "item_id", "start", "edits") == [(5, 1, 0, 4)]


# 3


def test_language_held_out_accuracy(spark, odd_docs, no_docs):
    found = language.query(spark, SF).join(documents(spark).select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.97 * found.count()
    model = language.fit(documents(spark))
    got = {r["doc_id"]: r for r in language.identify(odd_docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (8, 9, 10, 11)) and 0 <= got[0]["score"] <= 1
    assert language.identify(odd_docs, model).count() == odd_docs.count() and language.identify(no_docs, model).count() == 0
    assert language.fit(no_docs) is None and {r["lang_pred"] for r in language.identify(odd_docs, None).collect()} == {"und"}


# 4


def test_language_training_holds_its_sample_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text RLIKE '[a-z]'")
    tracemalloc.start()
    model = language.fit(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.languages) > 1
    assert peak < 2 * docs.count() * language.BUCKETS * 2  # bytes of the vectors in half precision


def test_machines_are_the_same_in_half_precision():
    rng = np.random.default_rng(1)
    x = rng.random((150, language.BUCKETS)).astype(np.float16)
    lang = np.array(["en", "de", "fr"])[np.arange(150) % 3]
    half, single = language.Model(x, lang), language.Model(x.astype(np.float32), lang)
    assert (half.w == single.w).all() and (half.b == single.b).all() and (half.scale == single.scale).all()


def test_quality_counts_and_verdict(spark, odd_docs, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {(r["doc_id"]): r for r in quality.query(spark, SF).collect()}
    for d in documents(spark).collect():
        words = WORD.findall(d["text"])
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
        lines = [x for x in d["text"].split("\n") if WORD.search(x)]
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", d["text"])), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r["base_failed"] and r["kept"])
    judged = [(x["quality"], got[x["doc_id"]]) for x in labels.collect()]
    good = [r["kept"] for q, r in judged if q == 1 and not r["base_failed"]]
    bad = [r["kept"] for q, r in judged if q == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.3
    assert quality.quality_rules(odd_docs, labels).count() == odd_docs.count()
    assert quality.quality_rules(no_docs, labels).count() == 0
    assert quality.quality_rules(odd_docs, labels.limit(0)).filter("kept = base_failed").count() == 0


# 5


def test_extraction_of_known_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner)]
        assert html.extract(r["html"]) == "\n\n".join(b for b in blocks if b)


def test_extraction_odd_pages(spark):
    page = (
        "<body><nav><a href=/>home page</a></nav><div class='cookie-notice'>we use cookies for many things</div><main><h1>Head line</h1><p>Some words of the text &amp; more of them in here.</p>"
        "<div class=ad>buy this thing now</div><script>var a='<p>x</p>'</script><p>The second part goes on and on about it.</p></main><section id=comments><p>first post of a reader, long and loud</p></section></body>"
    )
    assert html.extract(page) == "Head line\n\nSome words of the text & more of them in here.\n\nThe second part goes on and on about it."
    assert [html.extract(x) for x in (None, "", "<div></div>", "plain words only", "<p>a<p>b", "<", "<!-- x")] == ["", "", "", "plain words only", "a\n\nb", "<", ""]
    df = spark.createDataFrame([(1, "u", None), (2, None, "<p>x y"), (2, None, "<p>x y"), (None, "u", "<p>" + "word " * 200_000)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    assert rows(html.main_text(df), "page_id", "n_chars") == sorted([(1, 0), (2, 3), (2, 3), (None, 999_999)], key=str)
    assert html.main_text(df.limit(0)).count() == 0


def test_extraction_without_telling_names():
    text = "<p>This is a paragraph of the main text, which goes on for a while and says something about the world. It ends here.</p>"
    said = "I really liked this piece and wanted to say so at some length, as one does. Great work indeed, thanks."
    want = "\n\n".join([text[3:-4]] * 5)
    entries = ["".join(f"<div><b>Ann {k}</b><p>{said}</p></div>" for k in range(6)), f"<p>{said}</p>" * 6]
    assert all(html.extract(f"<body><div>{text * 5}</div><div class='user-posts'>{e}</div></body>") == want for e in entries)
    assert html.extract(f"<body><div>{text * 5}</div><div class='zq'>{entries[0]}</div></body>") == want
    table = f"<table><tr><td>Home About us Contact</td><td>{text * 5}</td></tr><tr><td>Copyright 2020 Some Firm</td></tr></table>"
    assert html.extract(f"<body>{table}</body>") == want
    assert html.extract(f"<article>{text * 5}<p>All rights reserved.</p></article><footer>&copy; x</footer>") == want + "\n\nAll rights reserved."
    assert html.extract("<main><h2>One</h2><ul><li>apples</li><li>pears</li></ul><p>So be it</p></main>") == "One\n\napples\n\npears\n\nSo be it"


@pytest.mark.parametrize("markup", ["<a ", "<!--", '<div class="', "<a '\">", "<div><p>", "<span>", "</x>", '<a ">"', "<b><div>", "<script>", "<![CDATA[", "<p class='a", "<", "<i><div></i>", "&amp;", "<p>x"])
def test_hostile_markup_takes_linear_time(markup):
    start = time.process_time()
    assert html.extract("<p>one paragraph of words that are text.</p>" + markup * (2_000_000 // len(markup))).startswith("one paragraph of words")
    assert time.process_time() - start < 30


def test_best_region_is_best():
    rnd = random.Random(2)
    for _ in range(300):
        s = [rnd.randrange(-5, 6) for _ in range(rnd.randrange(12))]
        a, b = html.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


# 6 and 10


def reference_ids(texts, special_as_text=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.word_tokenizer())
    t.encode_special_tokens = special_as_text
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_library(spark):
    odd = ["", "it's I'm foo's", "H̱ello ẖ", "ΣΑΣ", "İ K Å", "a b c\u0085x\x1cy", "é x'́", "12a!!", "<|endoftext|>", "日本語。 👍🏽", "ß ﬁ ǅ"]
    odd += ["see <|endoftext|> here", "glued<|startoftext|><|endoftext|>on", "<|ENDOFTEXT|> <|endoftext", "é<|endoftext|>'s"]
    odd += [r["text"] for r in documents(spark).select("text").collect()]
    for special_as_text in (False, True):
        e = tokens.Encoder(tokens.word_tokenizer(), special_as_text)
        assert [np.frombuffer(e.encode(x.encode()), e.dtype).tolist() for x in odd] == reference_ids(odd, special_as_text)


def test_token_files_round_trip(spark, odd_docs, no_docs):
    for docs in (documents(spark), odd_docs):
        data = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        at, want = 0, []
        for (d, _), ids in zip(data, reference_ids([t for _, t in data]), strict=True):
            want.append((d, at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
            at += len(ids) + 1
        assert rows(binary.digests(binary.encode(docs, tasks=3)), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    assert binary.digests(binary.encode(no_docs)).count() == 0


def test_elias_fano():
    rnd = np.random.default_rng(3)
    for n, u in ((1, 0), (1, 9), (100, 100), (777, 10**9), (64, 64 * 5), (300, 2**62)):
        v = np.sort(rnd.integers(0, u + 1, n))
        e = binary.EliasFano.from_bytes(binary.EliasFano.encode(v).to_bytes())
        assert (e.decode() == v).all() and [e.select(i) for i in range(n)] == v.tolist()


def test_segments_select_documents_without_decoding(monkeypatch):
    monkeypatch.delattr(binary.EliasFano, "decode")
    names = [None, None, -(2**62), -5, 0, 0, 7, 2**62]
    ends = [1, 4, 5, 9, 9, 10, 400, 401]
    here = binary.Segment(binary.Segment.write(np.arange(401, dtype="<u2").tobytes(), 2, ends, names))
    assert [here.doc_id(i) for i in range(8)] == names and [here.boundaries.select(i) for i in range(9)] == [0, *ends] and here.ids.tolist() == list(range(401))


def test_packing_of_many_rows_without_id(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.expr("repeat('word ', 1 + id % 1500)").alias("text"))
    got = packing.pack(packing.cut(docs), 4000, limit=64)
    sizes = [r["n"] for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(sizes) == sum(2 + k % 1500 for k in range(4000)) and max(sizes) <= 2048 and len(sizes) <= 1.05 * sum(sizes) / 2048
    shares = Counter(r["sequence_id"] >> 40 for r in got.collect())
    assert len(shares) == 2 and min(shares.values()) > 1800


def test_packing_is_whole_and_tight(spark, odd_docs, no_docs):
    for docs in (documents(spark), odd_docs):
        data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = Counter()
        for (d, _), ids in zip(data, reference_ids([t for _, t in data]), strict=True):
            ids = np.array([*ids, 0], "<u4")
            want.update((d, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
        got = packing.best_fit(docs).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        bins = {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert bins.get(r["sequence_id"], 0) == r["offset"]
            bins[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(bins.values()) <= 2048
        assert len(bins) <= 1.1 * sum(bins.values()) / 2048 + 3
    assert packing.best_fit(no_docs).count() == 0


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0) and bins.place(8)[0] == 2
    assert bins.place(3) != (1, 7)  # bin 1 was the fullest of the two and has closed


# 7


def removed(docs):
    first, out = {}, []
    for d, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first.get(b[i : i + 50], d) < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for k, docs in enumerate((documents(spark), odd_docs)):
        data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert rows(suffix_dedup.query(spark, f"{tmp_path}/{k}"), *columns) == sorted(removed(data), key=str)
    assert suffix_dedup.remove_repeats(odd_docs).columns == odd_docs.columns and suffix_dedup.remove_repeats(odd_docs).count() == odd_docs.count()
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_long_texts_are_parsed_in_pieces(spark, tmp_path):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(2_300_000))
    docs = [(1, long), (2, long[1_048_500:1_048_700]), (3, "x" * 10 + long[-100:])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["n_removed"], r["n_spans"]) for r in suffix_dedup.query(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, 0), (200, 1), (100, 1)]


def test_long_runs_of_a_short_period(spark, tmp_path):
    rnd = random.Random(8)
    shared = ["".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(40)]
    runs = ["-" * 70_001, "0123456789abc" * 5_400, "no " * 30_000]
    docs = [(1, "one" + "".join(shared[:20] + runs + shared[20:])), (2, "two" + runs[1] + "".join(shared[::-1]) + runs[0] + "x" + runs[2][:80_000]), (3, runs[0][:66_000] + shared[3])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(suffix_dedup.query(spark, str(tmp_path)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(removed(docs), key=str)


@pytest.mark.parametrize("hot", [1, 2])
def test_strings_of_hot_triggers_are_dealt_one_by_one(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_PHRASES", hot)
    rnd = random.Random(9)
    say = lambda n: "".join(rnd.choice("abcdefgh ü") for _ in range(n))
    passages = [say(n) for n in (49, 50, 51, 90, 400)]
    docs = [(k, say(rnd.randrange(90)) + rnd.choice(passages) + say(rnd.randrange(60)) + rnd.choice(passages)) for k in range(120)] + [(7, passages[4]), (None, passages[4])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(suffix_dedup.query(spark, str(tmp_path)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(removed(docs), key=str)


def test_suffix_array_is_in_byte_order():
    rnd = random.Random(10)
    raw = bytes(rnd.choice(b"ab\xff\x00") for _ in range(400)) * 3
    at = np.array(rnd.sample(range(len(raw) - 49), 700))
    order, new = suffix_dedup.suffix_array(raw, at)
    strings = [raw[i : i + 50] for i in at[order].tolist()]
    assert strings == sorted(strings) and new.tolist() == [True, *(a != b for a, b in zip(strings, strings[1:], strict=False))]


# 8


def linked(docs, width, percent):
    def shingles(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t in docs]
    up = {d: d for d, _ in docs if d is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return [(d, len(s), None if d is None else root(d) if s else d) for d, s in sets]


@pytest.mark.parametrize(("width", "percent", "part"), [(3, 90, None), (5, 80, None), (3, 90, 800)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, part):
    if part:
        monkeypatch.setattr(jaccard, "PART_SHINGLES", part)
        monkeypatch.setattr(jaccard, "PART_SETS", 5)
    rnd = random.Random(6)
    base = [[f"w{rnd.randrange(400)}" for _ in range(n)] for n in (30, 60, 60, 120, 200)]
    docs = []
    for w in base:
        for _ in range(14):  # chains of edits, so that components are wider than links
            w = list(w)
            for _ in range(rnd.randrange(1, 3)):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(400)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(200, None), (201, ""), (202, "a b"), (203, "A  B"), (204, "c"), (203, "A  B")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("set_id", F.lit(1))
    assert rows(jaccard.jaccard_components(df, width, percent), "doc_id", "n_shingles", "component_id") == sorted(linked(docs, width, percent), key=str)


def test_one_shingle_in_all_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "PART_SETS", 7)
    rnd = random.Random(16)
    docs = [(k, "all rights reserved " + " ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.choice((0, 1, 2, 12))))) for k in range(150)]
    docs += [(k + 150, t + " w7") for k, t in docs[::3]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard.jaccard_components(df, 3, 90), "doc_id", "n_shingles", "component_id") == sorted(linked(docs, 3, 90), key=str)
    assert rows(jaccard.jaccard_components(df, 3, 50), "doc_id", "n_shingles", "component_id") == sorted(linked(docs, 3, 50), key=str)


def test_components_of_odd_tables(spark, odd_docs, no_docs):
    data = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows(jaccard.jaccard_components(odd_docs, 3, 90), "doc_id", "n_shingles", "component_id") == sorted(linked(data, 3, 90), key=str)
    assert jaccard.jaccard_components(no_docs, 3, 90).count() == 0


def test_tree_walk_loses_no_pair():
    rnd = random.Random(7)
    texts = [" ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 40))).encode() for _ in range(150)]
    h, s = shingle_sets(texts, 1)
    bits, sampled = jaccard.signatures(h, s)
    sizes = np.diff(s)
    found = {(int(i), int(j)) for a, b in jaccard.SignatureTree(bits, sizes, sampled).walk(60, lambda *_: False) for i, j in zip(a, b, strict=True)}
    sets = [set(h[a:b].tolist()) for a, b in zip(s, s[1:], strict=False)]
    assert {(i, j) for j in range(150) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])} <= found


# 9


def test_chat_log_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "he"), (1, 2, 4, "delta", None, "llo"), (1, 3, 5, "message", "user", "more"), (1, 4, 6, "message", "assistant", "x"),
        (1, 2, 7, "regenerate", None, "Hey"), (1, 3, 8, "message", "user", "and?"), (1, 4, 9, "delete", None, None), (2, 1, 1, "message", "user", "a"), (2, 1, 2, "edit", None, "b"), (None, 1, 1, "message", "user", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, message long, seq long, event string, role string, text string").withColumn("key", F.lit(1))
    assert rows(chat.fold(df), "conv_id", "message", "role", "text") == sorted([(1, 1, "user", "hi"), (1, 2, "assistant", "Hey"), (1, 3, "user", "and?"), (2, 1, "user", "b"), (None, 1, "user", "")], key=str)


def test_chat_escapes_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<<SYS>>[\\INST]<\\s>", "", None, "[INST", "<<ROLE>> x <</ROLE>>", "a" * 300_000]
    said = [(1, i, r, t) for i, t in enumerate(texts) for r in ("user", "assistant", "system", "tool<s>", None)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    back = chat.parse(chat.render(df))
    assert rows(back, "turn", "role", "text") == sorted([(i, r or "", t or "") for _, i, r, t in said], key=str)
    assert rows(back.filter("role = 'assistant'"), "turn", "loss") == sorted([(i, t or "") for i, t in enumerate(texts)], key=str)
    assert chat.read_back(chat.render(df.limit(0))).count() == 0


def test_chat_reader_needs_no_segment_ends(spark):
    said = [(k, r, t) for k, (r, t) in enumerate([("system", "be [/INST] kind"), ("user", "</s>[INST] \\ ok [/INST]"), ("assistant", " <s> "), ("tool<s>", "x <</SYS>>"), ("assistant", ""), (None, None)] * 2)]
    df = spark.createDataFrame([(1, *x) for x in said], "conv_id long, turn long, role string, text string")
    whole = "".join(r["segment"] for r in chat.render(df).orderBy("turn").collect())
    want = [(r or "", t or "") for _, r, t in said]
    for step in (1, 3, 7, 1000):
        reader = chat.Reader()
        assert [x for k in range(0, len(whole), step) for x in reader.feed(whole[k : k + step])] == want and reader.held == ""


def test_chat_read_back_of_repeated_rows_and_no_conversation(spark):
    said = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "assistant", None), (2, None, None, None)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("z") for c in ("nth", "log", "seq", "last", "cut")})
    order = ("turn", "nth")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.as_events(df), order), order), order).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == {
        None: (2, sha("user\na\nassistant\nb\n"), 1, sha("b")), 1: (3, sha("user\nx\nuser\nx\nassistant\n\n"), 0, sha("")), 2: (1, sha("\n\n"), 0, sha("")),
    }