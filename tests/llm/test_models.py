import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, quality, urls
from tessera.scratch import Scratch

STEMS = {"en": "the of and ing tion ed", "fr": "les des que eau ment é", "de": "der die ung sch ich ä", "es": "los que ción ado ñ ar"}


@pytest.fixture(scope="module")
def spoken():
    def make(lang, seed, n=60):
        rng = np.random.default_rng([seed, sum(map(ord, lang))])
        stems = STEMS[lang].split()
        return " ".join("".join(rng.choice(stems, rng.integers(1, 4))) for _ in range(n))

    return make


# Language identification


def test_language_of_held_out_texts(spark, spoken):
    rows = [(k, spoken(lang, k), lang) for k, lang in enumerate(list(STEMS) * 60)]
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "12 !!", "de"), (1003, "the", None), (None, spoken("de", 1), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        r = got[i]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if i is not None and 1000 <= i <= 1002:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if i is not None and i < 1000 and got[i].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert got[None].lang_pred == "de"


def test_language_ignores_what_is_held_out_and_other_columns(spark, spoken):
    rows = [(k, spoken(lang, k), lang) for k, lang in enumerate(["en", "de"] * 40)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (
        sorted(map(str, langid.identify(spark.createDataFrame(r, schema)).collect())) for r in (rows, wrong)
    )
    assert a == b


def test_language_of_odd_rows(odd, odd_rows, none):
    got = langid.identify(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 11)} == {"und"}
    assert {r.lang_pred for r in got} <= {"und", "en", "fr"}
    assert langid.identify(none).collect() == []


def test_without_languages(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "d")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs).collect()} == {("und", 0.0)}


def test_codewords_are_far_apart():
    for count in (2, 4, 30):
        code = langid.codewords(count)
        apart = [(code[a] != code[b]).sum() for a in range(count) for b in range(a)]
        assert min(apart) >= code.shape[1] // 4
        assert (np.abs(code.sum(axis=0)) < count).all()


def test_decoding_corrects_a_wrong_bit():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((1, code.shape[1])), np.ones(code.shape[1]))
    margin = 4 * code.copy()
    margin[:, :3] *= -1
    model.margins = lambda counts: margin
    assert [r[0] for r in model.decode(np.zeros((4, 1)))] == list("abcd")
    model.margins = lambda counts: np.zeros((1, code.shape[1]))
    ((lang, score, _, close),) = model.decode(np.zeros((1, 1)))
    assert (lang, score, close) == ("a", 0.25, True)


# Quality


@pytest.fixture(scope="module")
def graded(spoken):
    rows, truth = [], {}
    for k in range(400):
        clean = spoken(list(STEMS)[k % 4], k, 80).split()
        kind = k % 10
        if kind == 0:
            made = [w.upper() + "!!" for w in clean]
        elif kind == 1:
            made = [w + "$$$" for w in clean]
        elif kind == 2:
            made = [w for w in clean[:8] for _ in range(12)]
        else:
            made = [quality_word(k, j) if j % 3 == 0 else w for j, w in enumerate(clean)]
        rows.append((k, " ".join(made)))
        truth[k] = kind > 2
    return rows, truth


def quality_word(k, j):
    return ("the", "de", "der", "la")[(k + j) % 4]


def test_quality_finds_junk_without_labels(spark, graded):
    rows, truth = graded
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.kept != truth[r.doc_id] for r in got) <= 4
    assert all(r.kept for r in got if truth[r.doc_id])
    assert all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in got)


CLEAN = {
    "pl": "Wczoraj wieczorem poszliśmy nad rzekę, gdzie dzieci rzucały kamienie i śmiały się głośno. "
    "Nikt nie wiedział, czy jutro będzie padać, ale wszyscy mieli nadzieję, że i tym razem się uda. ",
    "ru": "Вчера вечером мы пошли к реке, где дети бросали камни и громко смеялись. "
    "Никто не знал, будет ли завтра дождь, но все надеялись, что достопримечательности не закроют. ",
    "el": "Χθες το βράδυ πήγαμε στο ποτάμι, όπου τα παιδιά πετούσαν πέτρες και γελούσαν δυνατά. ",
    "hi": "कल शाम हम नदी के किनारे गए जहाँ बच्चे पत्थर फेंक रहे थे और ज़ोर से हँस रहे थे। ",
    "ja": "昨日の夕方、私たちは川へ行きました。 子供たちが石を投げて大声で笑っていました。 ",
}


@pytest.mark.parametrize("lang", CLEAN)
def test_no_labeller_is_against_a_further_language(lang):
    seen = quality.shape(CLEAN[lang] * 30)
    assert seen["words"] >= 40 and quality.BAD not in quality.votes(seen)


def test_function_words_still_judge_what_no_language_is():
    made = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}xqzk" for k in range(150))
    assert quality.votes(quality.shape(made))[5] == quality.BAD
    assert quality.votes(quality.shape(CLEAN["pl"].replace(" ", "$$$ ") * 3))[5] == quality.BAD


def test_quality_keeps_a_further_language(spark, graded):
    rows, truth = graded
    russian = CLEAN["ru"].split()
    more = [(1000 + k, " ".join((russian[k % 20 :] + russian) * 3)) for k in range(40)]
    got = quality.judge(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()
    assert all(r.kept for r in got if r.doc_id >= 1000)
    assert sum(r.kept != truth[r.doc_id] for r in got if r.doc_id < 1000) <= 4


def test_labels_equal_plain_expectation_maximisation():
    """On pattern counts the model is that of one document at a time."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 27, 200)
    unique, counts = np.unique(codes, return_counts=True)
    a = quality.fit_labels(unique, counts.astype(float), 3, rounds=20)
    b = quality.fit_labels(codes, np.ones(len(codes)), 3, rounds=20)
    assert np.allclose(a.posterior(unique), b.posterior(unique))
    by_hand = []
    for code in unique:
        each = []
        for share, rates in zip(a.shares, [a.on_good, *a.on_bad]):
            p = share
            for v, rate in zip((code // 9, code // 3 % 3, code % 3), rates):
                p *= {quality.GOOD: 1 - rate, quality.BAD: rate}.get(int(v), 1)
            each.append(p)
        by_hand.append(each[0] / sum(each))
    assert np.allclose(a.posterior(unique), by_hand)


def test_accuracies_are_recovered():
    rng = np.random.default_rng(9)
    n, kinds = 50_000, rng.choice(4, 50_000, p=[0.85, 0.05, 0.05, 0.05])
    cast = np.full((n, 3), quality.GOOD)
    for j in range(3):
        cast[(kinds == j + 1) & (rng.random(n) < 0.9), j] = quality.BAD
        cast[(kinds == 0) & (rng.random(n) < 0.002), j] = quality.BAD
    codes, counts = np.unique(cast @ np.array([9, 3, 1]), return_counts=True)
    model = quality.fit_labels(codes, counts.astype(float), 3)
    assert np.allclose(model.accuracies()[:, 0], 0.998, atol=0.01)
    wrong = (model.posterior(cast @ np.array([9, 3, 1])) > 0.5) != (kinds == 0)
    assert wrong.mean() < 0.03


def test_quality_of_odd_rows(odd, odd_rows, none):
    got = quality.judge(odd).collect()
    assert len(got) == len(odd_rows)
    assert {(r.score, r.kept) for r in got if r.doc_id in (4, 5, 6)} == {(0.0, False)}
    stage = quality.keep_good(odd)
    assert stage.schema == odd.schema
    kept = sorted(str(r.doc_id) for r in got if r.kept)
    assert sorted(str(r.doc_id) for r in stage.collect()) == kept
    assert quality.judge(none).collect() == [] and quality.keep_good(none).collect() == []


# Mixing


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture
def sources(spark, prose):
    rows = [(k, prose(k, 20 + k % 30), "big" if k % 3 else f"s{k % 5}") for k in range(600)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("limit", [1.0, 1.5, 3.0])
def test_repetition_limit(sources, limit):
    rows, docs = sources
    got = mixing.mix(docs, repeat_limit=limit).collect()
    tokens = {i: words_of(t) for i, t, _ in rows}
    total, read = {}, {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + tokens[i]
    for r in got:
        read[r.source] = read.get(r.source, 0) + tokens[r.doc_id]
    assert {r.doc_id for r in got} == set(tokens)
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    times = {s: read[s] / total[s] for s in total}
    assert min(times.values()) == 1 and max(times.values()) <= limit + 0.15
    weight = {r.source: r.weight for r in got}
    assert sum(weight.values()) == pytest.approx(1)
    assert all(read[s] / sum(read.values()) == pytest.approx(weight[s], abs=0.03) for s in weight)


def test_entropy_is_met(sources, spark):
    rows, docs = sources
    weight = {r.source: r.weight for r in mixing.mix(docs, entropy=1.5, repeat_limit=None).collect()}
    assert -sum(w * math.log(w) for w in weight.values()) == pytest.approx(1.5, abs=1e-4)
    flat = {r.source: r.weight for r in mixing.mix(docs, entropy=99.0).collect()}
    assert max(flat.values()) == pytest.approx(min(flat.values()))


def test_exponent_equals_bisection(spark):
    share = [0.5, 0.3, 0.15, 0.05]
    frame = spark.createDataFrame([(s, int(1000 * s)) for s in share], "share double, tokens long")

    def entropy(e):
        w = np.array(share) ** e / (np.array(share) ** e).sum()
        return -(w * np.log(w)).sum()

    low, high = 0.0, 8.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 1.0 else (low, mid)
    assert mixing.exponent(frame, entropy=1.0) == pytest.approx(low, abs=1e-6)
    # The largest weight over its share is (10) ** (1 - e) times the smallest.
    assert mixing.exponent(frame, repeat_limit=2.0) == pytest.approx(1 - math.log(2) / math.log(10), abs=1e-6)


def test_budget_and_order(sources):
    rows, docs = sources
    got = mixing.mix(docs, budget=8000, entropy=1.6).orderBy("position").collect()
    read = sum(r.tokens for r in got)
    assert read == pytest.approx(8000, rel=0.1)
    half = [r.source for r in got[: len(got) // 2]]
    assert half.count("big") / len(half) == pytest.approx([r.source for r in got].count("big") / len(got), abs=0.1)


def test_the_stage_keeps_the_order(sources):
    """The rows of the stage are those of the query in the order of their positions."""
    _, docs = sources
    want = [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]
    got = [r.doc_id for r in mixing.mixed(docs).collect()]
    assert sorted(got) == sorted(want)
    differ = sum(a != b for a, b in zip(got, want))  # equal positions may change places
    assert differ <= len(want) // 20


def test_mixing_odd_rows(odd, odd_rows, none):
    got = mixing.mix(odd).collect()
    first = [str(r.doc_id) for r in got if r.epoch == 0]
    assert sorted(first) == sorted(str(r[0]) for r in odd_rows)
    stage = mixing.mixed(odd)
    assert stage.schema == odd.schema and stage.count() == len(got)
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []


def test_mixing_runs_no_python(odd):
    assert not re.search("Python|Arrow|Pandas", mixing.mix(odd)._jdf.queryExecution().toString())


# URLs


def parts(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def ruled(host, path):
    fits = []
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits, default=(0, None, None))[1:]


URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/x?q#f", "http://www.Example.com/en/a", "ftp://x.net/es/1",
    "http://net/fr/", "http://a.net/fr", "http://anet/fr/", "x://y.com", "x://y.com?/en/", "x://y.com#/", "x://y.com/",
    "a://b://c.net/es/", "http://example.com/en/\n://z", "http://É.NET/fr/É", "http://m.www.example.com/en/1", "://k.com/",
    "http://u@example.com:80/en/", "http://example.com/EN/", "http://example.com//en/",
]


def test_rules(spark):
    rows = [(k, u) for k, u in enumerate(URLS * 2)] + [(None, URLS[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("host", F.lit(1))
    got = urls.judge_urls(pages).collect()
    assert len(got) == len(rows)
    known = dict(rows)
    for r in got:
        host, path = parts(known[r.page_id])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    by_url: dict = {}
    for r in got:
        by_url.setdefault(known[r.page_id], set()).add((r.verdict, r.score))
    assert all(len(v) == 1 for v in by_url.values())


def test_trees_learn_what_blocked_urls_look_like(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        bad = k % 2 == 0
        path = "/es/" if bad else "/de/"
        query = "?" + "&".join(f"k{j}={rng.integers(1e6)}" for j in range(8)) if bad else ""
        host = ("x.net", "y.com", "z.org")[0 if bad else 1] if k < 500 else "z.org"
        rows.append((k, f"http://{host}{path}{rng.integers(1000)}{query}"))
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).where("rule IS NULL").collect()
    assert len(got) == 100
    assert sum((r.verdict == "block") == (r.page_id % 2 == 0) for r in got) >= 95


def test_urls_of_one_kind_and_none(spark):
    def verdicts(found):
        return {r.verdict for r in urls.judge_urls(spark.createDataFrame(found, "page_id long, url string")).collect()}

    assert verdicts([(1, "http://a.com/"), (2, "http://b.org/")]) == {"allow"}
    assert verdicts([(1, "http://a.net/es/"), (2, "http://b.org/")]) == {"block"}
    assert verdicts([(1, None), (2, "http://b.org/")]) == {"allow"}
    assert verdicts([]) == set()


def test_entropy_and_plan(spark):
    frame = Scratch(spark).write(spark.createDataFrame([("aabb",), ("",), ("abcdefgh",), ("aaaa",)], "url string"), "u")
    got = {r.url: r.entropy for r in urls.lexical(frame).collect()}
    assert got == {"aabb": 1.0, "": 0.0, "abcdefgh": 3.0, "aaaa": 0.0}
    plan = urls.judge_urls(spark.createDataFrame([(1, "http://a.net/es/"), (2, "http://b.com/")], "page_id long, url string"))
    assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().toString())
