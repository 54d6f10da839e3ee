import hashlib
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.llm import decontaminate, langid, licenses, qualityrules, urlfilter, weakquality
from kinspark.llm.queries import URL_RULES
from kinspark.sources.models import load_model, save_model

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- URLs

URLS = [
    None, "", "x", "http://", "http://net", "http://NET/", "https://a.b.Example.NET/en/x?y#z", "http://xnet/", "http://example.net/en", "http://a.example.com/de/",
    "http://example.com/DE/", "http://x.odd.com/abc", "http://x.odd.com/a", "http://é.net/ü", "http://a..net//", "http://user@net/", "http://net:80/", "://org/fr/",
    "http://bexample.com/de/", "http://.example.com/de/", "a\nb://org/fr/\nx", "http://org?x/fr/", "http://.net/", "http://net./", "http://a.net#/en/", "x://y://net/", "http://net/" + "a/" * 300,
]


def judged(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    h, p = (m[1].translate(LOW), m[2]) if m else ("", "")
    fit = [(len(a + b), len(a), a + b, v) for v, a, b in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
    return (h, p, max(fit)[2], max(fit)[3]) if fit else (h, p, None, "allow")


@pytest.mark.parametrize("most", [0, 1000])
def test_urls_are_brute_force(spark, most):
    rules = [*URL_RULES, ("block", "odd.com", "/ab")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://net/", "h"), (5, "http://NET/", "h")], "page_id long, url string, host string")
    got = Counter(tuple(r) for r in urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, rules), broadcast_rules=most, most_broadcast=most, most_lengths=most).collect())
    assert got == Counter((r.page_id, *judged(r.url, rules)) for r in pages.collect())
    none = urlfilter.filter_urls(pages.limit(0), urlfilter.rules_frame(spark, rules))
    assert none.count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, rules).limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("most", [0, 1000])
def test_urls_with_very_many_labels_and_slashes(spark, most):
    rules, n = [*URL_RULES, ("block", "odd.com", "/ab")], 200_000
    urls = ["http://" + "a." * n + "net/" + "b/" * n, "http://" + "a." * n + "example.com/de/" + "b/" * n, "http://" + "a" * n + "example.com/de/", "http://odd.com/ab" + "b" * n, "http://" + "net/" * n]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, rules), broadcast_rules=most, most_broadcast=most, most_lengths=most)
    assert {tuple(r) for r in got.collect()} == {(i, *judged(u, rules)) for i, u in enumerate(urls)}


def test_the_stricter_of_equal_rules_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    rules = urlfilter.rules_frame(spark, [("allow", "a.b", "/"), ("block", "A.b", "/")])
    assert urlfilter.filter_urls(pages, rules).first().verdict == "block"


# --- decontamination


def contaminated(docs, bench, width=13):
    def words(t):
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))

    windows = {}
    for item, text in bench:
        w = words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= found
        items = sorted(str(i) for i in items if i is not None)
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
BENCH = [(1, LONG), (2, "short Item"), (3, "É été"), (4, "solo"), (5, None), (6, "..."), (None, "no id here at all"), (7, "a a a a"), (10, LONG)]
TEXTS = [
    None, "", "...", "solo", "Solo, SOLO!", LONG, LONG.upper() + " more words " * 200, "x " + LONG[4:], "a short item, short  item", "é été É été", "a a a a a a a", "no id here at all " * 3,
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen", "filler " * 3000 + LONG,
]


@pytest.mark.parametrize("most", [0, 1000])
def test_contamination_is_brute_force(spark, most):
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in enumerate(TEXTS)] + [(None, LONG, 1, "p"), (5, LONG, 1, "p"), (5, "clean", 1, "p")], "doc_id long, text string, w long, pos string")
    bench = spark.createDataFrame([(i, t, "z") for i, t in BENCH], "item_id long, text string, items string")
    got = decontaminate.contamination(docs, bench, broadcast_windows=most, most_broadcast=most).drop("text_xxhash64").collect()
    clean = Counter((r[0], r[1]) for r in got if not r[5])
    kept = decontaminate.drop_contaminated(docs, bench, most_broadcast=most, broadcast_windows=most).collect()
    assert Counter((r.doc_id, len(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r.text or "").translate(LOW)))) for r in kept) == clean
    assert Counter(tuple(r) for r in got) == contaminated([(r.doc_id, r.text) for r in docs.collect()], BENCH)
    assert decontaminate.contamination(docs.limit(0), bench, broadcast_windows=most).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0), broadcast_windows=most).collect()} == {0}


def test_whole_table_and_no_python_in_the_plan(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontaminate.contamination(docs, bench).drop("text_xxhash64")
    assert Counter(tuple(r) for r in got.collect()) == contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == got.where("not contaminated").count()


@pytest.mark.parametrize("most", [0, 200_000])
def test_short_items_and_a_text_of_a_hundred_thousand_words(spark, most):
    text = " ".join(f"w{i}" for i in range(100_000)) + " short item solo"
    docs = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    bench = [(1, "short item"), (2, "solo"), (3, " ".join(f"w{i}" for i in range(40, 60)))]
    got = decontaminate.contamination(docs, spark.createDataFrame(bench, "item_id long, text string"), broadcast_windows=most).drop("text_xxhash64")
    assert Counter(tuple(r) for r in got.collect()) == contaminated([(1, text), (2, "nothing here")], bench)


# --- language


def test_languages_are_learnt_and_odd_texts_have_results(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_language_model(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    same = langid.fit_language_model(docs.withColumn("lang", F.when(langid.held_out("doc_id"), "xx").otherwise(F.col("lang"))))
    assert same.languages == model.languages and np.array_equal(same.weights, model.weights)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in langid.identify(odd, langid.fit_language_model(empty)).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    assert langid.keep_identified(docs, model).count() > 0.98 * docs.count()


FOREIGN = (
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
)


def test_foreign_texts_and_noise_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_language_model(docs)
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), n)) for n in (60, 300, 3000, 30_000)]
    planted = spark.createDataFrame([(i, t) for i, t in enumerate([*FOREIGN, *(" ".join([t] * 9) for t in FOREIGN), *noise])], "doc_id long, text string")
    assert langid.keep_identified(planted, model).count() == 0
    assert langid.keep_identified(docs.where(langid.held_out("doc_id")), model).count() >= 0.99 * docs.where(langid.held_out("doc_id")).count()
    left = langid.fit_language_model(docs.where("lang <> 'es'"))
    spanish = docs.where("lang = 'es' and length(text) > 400")
    assert langid.keep_identified(spanish, left).count() < 0.1 * spanish.count()


def test_null_and_repeated_ids_keep_the_bound(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    sizes, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: (sizes.append(len(rows := collect(self))), rows)[1])
    many = docs.crossJoin(spark.range(4)).select("doc_id", F.concat("text", F.lit(" x"), F.col("id").cast("string")).alias("text"), "lang")
    for ids in (F.lit(None).cast("long"), F.lit(4).cast("long")):
        sizes.clear()
        assert langid.fit_language_model(many.withColumn("doc_id", ids), per_language=50).languages == ["de", "en", "es", "fr"]
        assert 4 * 50 <= max(sizes) <= 4 * 250
    one = docs.where("doc_id is not null and text is not null").orderBy("doc_id").limit(1)
    copies = one.withColumn("doc_id", F.lit(None).cast("long"))
    want = langid.fit_language_model(docs.union(copies), per_language=50)
    got = langid.fit_language_model(docs.union(copies.crossJoin(spark.range(3000)).drop("id")), per_language=50)
    assert np.array_equal(got.weights, want.weights)


@pytest.fixture(scope="module")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_scores_do_not_depend_on_length(spark, small_docs):
    model = langid.fit_language_model(small_docs)
    rows = [r for r in small_docs.where("lang is not null and length(text) > 200").select("lang", "text").collect()]
    for lang in model.languages:
        own = [r.text for r in rows if r.lang == lang]
        single = np.mean(model.predict(own)[1])
        (name,), (score,) = model.predict([" ".join(own)])
        assert name == lang and score > 0.9 * single and score >= langid.UNLIKE
    chinese = "".join(map(chr, np.random.default_rng(0).integers(0x4E00, 0x9FFF, 20_000)))
    assert max(w[0].mean() for w in langid.windows_of(chinese, model.bits)) < 0.5
    assert sum(w[1] for w in langid.windows_of("a1" * 5000, 14)) == 5000 and list(langid.windows_of("12 " * 5000, 14)) == []


def test_regression_is_brute_force_kernel_ridge(small_docs):
    docs = small_docs.where("length(text) between 100 and 2000").orderBy("doc_id").limit(120)
    model = langid.fit_language_model(docs, landmarks=10_000, ridge=0.3)  # every window is a landmark: nothing is left out
    rows = docs.collect()
    learnt = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    grams = {r.doc_id: set(np.flatnonzero(langid.presence(r.text, 14)[0]).tolist()) for r in rows}
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(grams[a.doc_id], grams[b.doc_id]) for b in learnt] for a in learnt])
    y = np.array([[1.0 if r.lang == x else -1.0 for x in model.languages] for r in learnt])
    size = np.array([sum(r.lang == x.lang for x in learnt) for r in learnt])
    alpha = np.linalg.solve(k + 0.3 / len(learnt) * np.diag(size), y)
    for r in rows:
        want = np.array([kernel(grams[r.doc_id], grams[b.doc_id]) for b in learnt]) @ alpha
        bits = langid.presence(r.text, 14)[0].astype(np.float32)
        assert bits @ model.weights / np.sqrt(bits.sum()) == pytest.approx(want, abs=2e-3)


def test_models_are_kept_as_they_are(spark, small_docs, tmp_path):
    texts = [r.text for r in small_docs.limit(60).collect()]
    for name, model, judge in (
        ("language", langid.fit_language_model(small_docs), lambda m: m.predict(texts)),
        ("quality", weakquality.fit_quality_model(small_docs), lambda m: m.scores(texts).tolist()),
        ("ratio", qualityrules.fit_ratio(small_docs, small_docs.where("doc_id % 2 = 0")), lambda m: [m.score(t) for t in texts]),
    ):
        save_model(spark, model, f"{tmp_path}/{name}")
        assert judge(load_model(spark, type(model), f"{tmp_path}/{name}")) == judge(model)


def test_too_many_languages_are_an_error(small_docs):
    with pytest.raises(ValueError, match="languages"):
        langid.fit_language_model(small_docs, most_languages=3)


def test_stages_that_filter_take_odd_rows(odd, empty, small_docs):
    language, quality = langid.fit_language_model(small_docs), weakquality.fit_quality_model(small_docs)
    bench = odd.sparkSession.createDataFrame([(1, "the cat sat the cat sat")], "item_id long, text string")
    for keep in (lambda d: langid.keep_identified(d, language), lambda d: weakquality.keep_good(d, quality), lambda d: decontaminate.drop_contaminated(d, bench)):
        kept = keep(odd)
        assert kept.columns == odd.columns and Counter(map(tuple, kept.collect())) <= Counter(map(tuple, odd.collect()))
        assert keep(empty).count() == 0


# --- quality


def test_weak_labels_find_junk_and_keep_the_rest(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = weakquality.fit_quality_model(docs)
    got = weakquality.score_quality(docs, model).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.05
    assert weakquality.score_quality(odd, model).count() == odd.count() and weakquality.score_quality(empty, weakquality.fit_quality_model(empty)).count() == 0
    assert weakquality.fit_quality_model(odd).weights.shape == model.weights.shape


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.uniform(size=20_000) < 0.8
    fire = np.where(good[:, None], rng.uniform(size=(20_000, 4)) < 0.01, rng.uniform(size=(20_000, 4)) < [0.6, 0.5, 0.7, 0.4])
    patterns, counts = np.unique(np.where(fire, weakquality.BAD, weakquality.GOOD), axis=0, return_counts=True)
    model = weakquality.fit_label_model(patterns, counts.astype(float))
    assert model.good == pytest.approx(0.8, abs=0.02) and model.right_bad == pytest.approx([0.6, 0.5, 0.7, 0.4], abs=0.04)


def plain_em(votes, quiet, weight, rounds):
    """EM document by document, in plain Python."""
    m, n = len(votes[0]), len(votes)
    good, rg, rb = 0.9, [quiet] * m, [0.3] * m
    prior = weight * n + 1
    for _ in range(rounds):
        p = []
        for v in votes:
            a, b = good, 1 - good
            for x, g, d in zip(v, rg, rb, strict=True):
                a *= {1: g, -1: 1 - g, 0: 1}[x]
                b *= {1: 1 - d, -1: d, 0: 1}[x]
            p.append(a / (a + b))
        good = (sum(p) + 9) / (n + 10)
        rg = [(sum(q for q, v in zip(p, votes, strict=True) if v[j] > 0) + prior * quiet) / (sum(q for q, v in zip(p, votes, strict=True) if v[j]) + prior) for j in range(m)]
        rb = [(sum(1 - q for q, v in zip(p, votes, strict=True) if v[j] < 0) + 0.3) / (sum(1 - q for q, v in zip(p, votes, strict=True) if v[j]) + 1) for j in range(m)]
    return good, rg, rb


def test_label_model_is_plain_em(small_docs):
    votes = [weakquality.votes(r.text) for r in small_docs.select("text").collect()]
    patterns, counts = np.unique(np.array(votes), axis=0, return_counts=True)
    model = weakquality.fit_label_model(patterns, counts.astype(float), rounds=20)
    good, rg, rb = plain_em(votes, 0.99, 0.01, 20)
    assert model.good == pytest.approx(good, abs=1e-6)
    assert model.right_good == pytest.approx(np.clip(rg, 1e-6, 1 - 1e-6), abs=1e-6) and model.right_bad == pytest.approx(np.clip(rb, 1e-6, 1 - 1e-6), abs=1e-6)


def test_scorer_is_a_plain_linear_one(small_docs):
    model = weakquality.fit_quality_model(small_docs)
    for r in small_docs.limit(40).collect():
        data = (r.text or "").encode()
        grams = Counter((int.from_bytes(data[i : i + 3], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 20 for i in range(len(data) - 2))
        words = data.split()
        z = model.intercept + sum(model.weights[g] * np.sqrt(n / max(1, len(data) - 2)) for g, n in grams.items())
        z += model.weights[-1] * np.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)))
        assert model.scores([r.text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_logistic_regression_reaches_newtons_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)).astype(np.float32) / 3
    y = 1 / (1 + np.exp(-(x @ rng.normal(size=6) * 2 + 0.3)))
    w, b = weakquality._fit_scorer(x, y, l2=1e-2, rounds=3000)
    a, t = np.column_stack([x, np.ones(len(x))]).astype(float), np.zeros(7)
    ridge = np.diag([1e-2] * 6 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ t))
        t -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / len(x) + ridge, a.T @ (p - y) / len(x) + ridge @ t)
    assert [*w, b] == pytest.approx(t, abs=2e-2)


def test_quality_sample_keeps_its_bound(small_docs, monkeypatch):
    sizes, collect = [], type(small_docs).collect
    monkeypatch.setattr(type(small_docs), "collect", lambda self: (sizes.append(len(rows := collect(self))), rows)[1])
    spark = small_docs.sparkSession
    many = small_docs.crossJoin(spark.range(4)).select(F.lit(None).cast("long").alias("doc_id"), F.concat("text", F.lit(" x"), F.col("id").cast("string")).alias("text"))
    weakquality.fit_quality_model(many, sample_docs=200)
    assert 150 <= max(sizes) <= 600
    copies = small_docs.where("length(text) > 300").orderBy("doc_id").limit(1).crossJoin(spark.range(3000)).select(F.lit(None).cast("long").alias("doc_id"), "text")
    sizes.clear()
    weakquality.fit_quality_model(many.unionByName(copies), sample_docs=200)
    assert max(sizes) <= 600


def base(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_base_rules_are_brute_force(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = qualityrules.fit_ratio(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1"))
    for df in (docs, odd):
        for r in qualityrules.judge(df, model).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            b = base(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
            assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and (not r.kept or not r.base_failed)
    for t in ("a b c d e f g h", "a b c d e f g h a", "a b c d e f g h a b c d e f g h", "x " * 40, "a\n\na\n \na", "a\x1cb\x85c"):
        assert qualityrules.base_counts(t) == base(t)
    assert qualityrules.judge(odd, model).count() == odd.count() and qualityrules.judge(empty, qualityrules.fit_ratio(empty, empty)).count() == 0


def test_trusted_ids_by_shuffle_count_alike(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for d, trusted in ((docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")), (odd, odd.select("doc_id").where("doc_id is null or doc_id > 4"))):
        a, b = (qualityrules.fit_ratio(d, trusted, most_broadcast=n) for n in (0, 1000))
        assert np.array_equal(a.ratio, b.ratio) and a.ratio.any()


def test_ratio_drops_junk_and_keeps_what_is_trusted(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = qualityrules.fit_ratio(docs, labels.where("quality = 1"))
    got = qualityrules.judge(docs, model).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()
    kept = {r.quality: r.k for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.3


# --- licenses


def test_templates_are_found_and_changes_counted():
    for name, body in licenses.TEMPLATES:
        got = licenses.scan([f"foo bar\n\n{body}\n\nqux"])
        assert (name, 0) in {(x[0], x[2]) for x in got}
    changed = licenses.TEMPLATES[0][1].replace("AUTHORS OR COPYRIGHT HOLDERS", "FOO INC")
    ((name, _, off, _),) = licenses.scan([changed])
    assert name == "MIT" and off == 4
    two, three = (body for name, body in licenses.TEMPLATES if name in ("BSD-2-Clause", "BSD-3-Clause") and len(body) > 100)
    for text, want in ((two, ["BSD-2-Clause"]), (three, ["BSD-3-Clause"]), (three + "\n" + two, ["BSD-2-Clause", "BSD-3-Clause"]), ("\n".join([two, three, two]), ["BSD-2-Clause", "BSD-3-Clause"])):
        assert [(x[0], x[2]) for x in licenses.scan([text])] == [(n, 0) for n in want]
    assert [x[0] for x in licenses.scan(["// SPDX-License-Identifier: GPL-2.0-or-later\n# spdx-license-identifier:\tMIT"])] == ["GPL-2.0", "MIT"]


def test_one_page_of_a_hundred_thousand_words_is_quick():
    body = licenses.TEMPLATES[0][1]
    lines = "\n".join(f"Copyright (c) {y} Person {y}, permission is hereby granted" for y in range(12_000))
    started = time.time()
    assert [(x[0], x[2]) for x in licenses.scan([f"{lines}\n{body}\n{lines}"])] == [("MIT", 0)]
    assert time.time() - started < 20


def test_no_template_is_taken_for_another():
    for name, body in licenses.TEMPLATES:
        assert [(x[0], x[2]) for x in licenses.scan([f"foo bar {body} qux"])] == [(name, 0)]
    assert licenses.scan(["we need permission to walk this dog"]) == []
    assert licenses.wording_differences(["a", "b", "c"], ["x", "a", "c", "y"]) == 1


def test_license_scan_is_plain_search_on_the_table(spark, odd, empty):
    lines = {
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "proprietary": "All rights reserved.",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "MIT": "Released under the MIT License.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    }
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: set(filter(None, r.exact_licenses.split(","))) for r in licenses.scan_licenses(docs).collect()}
    assert got == {r.doc_id: {k for k, line in lines.items() if line in r.text} for r in docs.collect()}
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(empty).count() == 0


def long_line(rng, n, notice):
    letters, ends = "".join(map(chr, rng.integers(97, 123, 8 * n))), np.cumsum(rng.integers(2, 9, n)).tolist()
    words = [letters[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    at = int(rng.integers(0, n))
    return " ".join([*words[:at], notice, *words[at:]])


def test_notices_in_long_lines_are_found(spark):
    rng = np.random.default_rng(8)
    rows = [(name, long_line(rng, n, body)) for name, body in licenses.TEMPLATES for n in (20, 200, 2000, 20_000)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.exact_licenses.split(",") for r in licenses.scan_licenses(docs).collect()}
    assert all(name in got[i] for i, (name, _) in enumerate(rows))


@pytest.mark.parametrize("width", [20, 40, 60, 78])
def test_wrapped_notices_are_exact(width):
    for name, body in licenses.TEMPLATES:
        text = "x y z\n" * 3 + "\n".join(" * " + line for line in textwrap.wrap(body, width)) + "\nx y z" * 3
        assert (name, 0) in {(x[0], x[2]) for x in licenses.scan([text])}
    assert len(licenses._telling_runs("in the public\ndomain", 2)) == len(licenses._telling_runs("all rights  reserved", 2)) == 1


def test_all_notices_of_a_block_are_found():
    short = {name: body for name, body in licenses.TEMPLATES if len(body) < 150 and "SPDX" not in body}
    assert len(short) >= 6 and [x[0] for x in licenses.scan(["\n".join(short.values())])] == sorted(short)
    every = "\n".join(body for _, body in licenses.TEMPLATES)
    assert [(x[0], x[2]) for x in licenses.scan([every])] == sorted({(name, 0) for name, _ in licenses.TEMPLATES})


def least_edits(template, block):
    row = [0] * (len(block) + 1)
    for i, t in enumerate(template, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(block, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (t != b))
    return min(row)


def test_changed_notices_are_brute_force():
    rng = np.random.default_rng(9)
    families = [t for t in licenses.TEMPLATES if t[0] in ("MIT", "ISC", "Apache-2.0", "MPL-2.0", "Zlib", "BSL-1.0", "EPL-2.0", "CC0-1.0", "Unlicense", "proprietary")]  # no two share wording
    for name, body in families * 3:
        words = body.split()
        for _ in range(rng.integers(0, max(1, int(0.2 * len(words))) + 1)):
            at, how = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
            words[at : at + (how != 2)] = [] if how == 0 else [f"w{rng.integers(0, 99)}"]
        text = long_line(rng, 60, " ".join(words))
        want = {}
        for n, b in licenses.TEMPLATES:
            wanted = licenses.words_of(b)
            off = least_edits(wanted, licenses.words_of(text))
            if off <= int(0.15 * len(wanted)):
                want[n] = min(want.get(n, (9.0, 0)), (off / len(wanted), off))
        assert {x[0]: x[2] for x in licenses.scan([text])} == {n: off for n, (_, off) in want.items()}, (name, text)


def test_the_size_reduction_ranks_the_licenses_that_share_words():
    # Of the same nine words and one other; in the text a short word of one and a long word of the other differ.
    common = "this grant of rights covers all copies made by anyone"
    one, two = f"{common} heretofore incontrovertibly yes", f"{common} heretofore unquestionable yes"
    templates = [("A", f"{common} heretofore incontrovertibly no"), ("B", f"{common} nevertheless unquestionable yes")]
    for text, first in ((one, "A"), (two, "B")):
        known, by_start = licenses._compressors(tuple(templates), 0.3)
        ranked = licenses.candidates(licenses.words_of(text), known, by_start)
        assert known[ranked[0][1]].name == first and ranked[0][0] > ranked[1][0]
        assert [x[0] for x in licenses.scan([text], templates, most_changed=0.3)] == [first]
    # Two of A's short words differ and one of B's: words alone would choose B, the bytes saved choose A.
    text = f"{common} heretofore incontrovertibly by us".replace("made by", "made to")
    templates = [("A", f"{common} heretofore incontrovertibly to us"), ("B", f"{common} extraordinarily-incomprehensible incontrovertibly by us".replace("made by", "made to"))]
    off = {n: licenses.wording_differences(licenses.words_of(b), licenses.words_of(text)) for n, b in templates}
    assert off == {"A": 2, "B": 2} or off["B"] < off["A"]
    assert [x[0] for x in licenses.scan([text], templates, most_changed=0.3)] == ["A"]


def test_no_license_is_confirmed_without_a_size_reduction(monkeypatch):
    body = licenses.TEMPLATES[0][1]
    assert licenses.scan([body])
    monkeypatch.setattr(licenses._Template, "reduction", lambda self, words: (0.0, 0.0))
    licenses._compressors.cache_clear()
    try:
        assert licenses.scan([body]) == []
    finally:
        licenses._compressors.cache_clear()
