"""Operators 5, 7 and 9: exact parts against brute force, held-out quality."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimledger.llm import language, secrets, toxicity
from claimledger.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- secrets

def base(text):
    out = []
    for kind, pattern, least in (("assign", r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
                                 ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end()) for m in re.finditer(pattern, text)
                if len(m.group(1)) >= least]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "toKen", "ſecret", "api_key", "apiKey", "K", "=", ":", " ", '"', "'", "AKIA",
                                 "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "z", "é", "\n", "x" * 7]), max_size=14))
def test_base_findings(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == base(text)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = secrets.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.integers(0, 128, (6, secrets.WIDTH)), rng.integers(0, 2, 6).astype(float), np.ones(6)

    def loss():
        z = net._forward(x)[0]
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))
    grads = net._gradients(x, y, w)
    for key in ("out", "hide", "conv", "conv_b", "embed"):
        flat = np.abs(grads[key]).ravel()
        i = np.unravel_index(int(flat.argmax()), grads[key].shape)
        keep, eps = net.p[key][i], 1e-5
        net.p[key][i] = keep + eps
        up = loss()
        net.p[key][i] = keep - eps
        down = loss()
        net.p[key][i] = keep
        assert abs((up - down) / (2 * eps) - grads[key][i]) < 1e-3 * max(1, abs(grads[key][i]))


def test_windows_cover_a_candidate():
    text = "left " + "a1" * 70 + " right"
    found = secrets.windows(text, (5, 145))
    assert "".join(w[secrets.SIDE:secrets.SIDE + secrets.PIECE] for w in found).rstrip("\0") == "a1" * 70
    assert found[0].startswith("\0" * 11 + "left ") and all(len(w) == secrets.WIDTH for w in found)


def test_candidates():
    cut = lambda t: [t[a:b] for a, b in secrets.candidates(t)]
    assert cut("password is Tr0ub4dor3") == ["Tr0ub4dor3"]
    assert cut("Bearer abcdEFGHijklmn.") == ["abcdEFGHijklmn"]
    assert cut("password: hunterx, x = 'letmein'") == ["hunterx", "letmein"]
    assert cut("plain words without anything else, no 12345 either...") == []
    assert cut("aaaaaaaaaaaaaaaaaaaa") == ["aaaaaaaaaaaaaaaaaaaa"]
    rng = np.random.default_rng(4)
    for _ in range(300):  # every base finding's value is touched by a candidate
        t = "".join(rng.choice(["token", "=", ": ", '"', "abcdef", "a1", "AKIA" + "X2" * 9, "0af" * 8, " ", ".", "-"], 12))
        for s, _, e in secrets.base_spans(t):
            assert any(a < e and s < b for a, b in secrets.candidates(t)), t


def test_covered():
    base = [(0, 0, 10), (8, 2, 20), (25, 1, 30)]
    assert secrets.covered((3, 20), base) and not secrets.covered((3, 21), base) and not secrets.covered((22, 28), base)


def findings(spark, n):
    rng = np.random.default_rng(1)
    hexes = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    rows = []
    for i in range(n):
        value = [f'token = "{hexes(40)}"', f"password={hexes(18)}", "AKIA" + "".join(rng.choice(list("ABCDEFGH234567"), 16)),
                 "".join(rng.choice(list("0123456789"), 16)), f"user{i}.long@mail{i}.example.com", "internationalization2"][i % 6]
        rows.append((i, f"some words stand here {value} and more of them follow"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_network_adds_unruled_values_and_nothing_else(spark):
    docs = findings(spark, 1200)
    net = secrets.learn(docs)
    assert net is not None and min(net.recall.values()) >= 0.9
    fresh = spark.createDataFrame([
        (1, "here the value is 9f86d081884c7d659a2f00 and more words follow"),  # hex, too short for the rule
        (2, "some words stand here 4401234567890123 and more of them follow"),
        (3, "some words stand here user7.long@mail3.example.com and more"),
        (4, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'), (5, None), (6, "")], "doc_id long, text string")
    got = {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in secrets.scan(fresh, net).collect()}
    assert got == {1: [("model", 18, 40)], 2: [], 3: [], 4: [("assign", 0, 49), ("hex", 9, 49)], 5: [], 6: []}


def test_all_labelled_findings_are_learnt_from(spark):
    """13,000 candidates, and one of 2000 characters: none is left out, no piece either."""
    rows = [(i, " ".join(f"a{i}x{j}z" for j in range(1000, 1100))) for i in range(130)] + [(130, "k" * 2000), (131, None)]
    found = secrets.labelled_findings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() == 13_001
    assert found.where("length = 2000").selectExpr("size(w)", "size(marks)").first() == (42, 42)


def test_many_tasks_learn_one_network(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SHARE", 300)
    docs = findings(spark, 1200)
    one, two = secrets.learn(docs), secrets.learn(docs.repartition(5))
    assert min(one.recall.values()) >= 0.9
    assert all((one.p[k] == two.p[k]).all() for k in one.p) and abs(one.threshold - two.threshold) < 1e-6


def test_scan_of_odd_documents(odd, empty):
    assert secrets.learn(odd) is None and secrets.learn(empty) is None
    got = {r.doc_id: r.findings for r in secrets.scan(odd, None).collect()}
    assert len(got) == odd.select("doc_id").distinct().count() and not any(got.values())
    assert secrets.scan(empty, None).count() == 0


def test_secrets_query(spark):
    rows = secrets.q_secrets(spark, SF).collect()
    texts = dict(table(spark, SF, "documents").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        want = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base(texts[r.doc_id] or "")]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("model")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))


# ---------------------------------------------------------------- toxicity

def test_spans_equal_marginals_of_all_taggings(spark):
    field = random_field(6)
    model = toxicity.Model({"bad": 1, "wors-": 2, "vile": 3}, field, np.array([1.0, 1.0, 1.0, 0.0]))
    texts = ["you bad worse thing", "Vile \u0130stanbul, bad bad words", "nothing here", "", None, "bad", "worst 12 vile_bad \u00e9t\u00e9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end, round(x.probability, 9)) for x in r.spans] for r in toxicity.score(docs, model, True).collect()}
    for k, t in enumerate(texts):
        tokens = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t or "")]
        words = [(t[a:b].lower() if t[a:b].isascii() else t[a:b]) for a, b in tokens]
        cls = np.array([1 if w == "bad" else 2 if w.startswith("wors") else 3 if w == "vile" else 0 for w in words], int)
        want = []
        if len(cls):
            e = field.potentials(cls[None, :])[0]
            tags = list(itertools.product((0, 1), repeat=len(cls)))
            w = np.array([np.exp(sum(x * y for x, y in zip(g, e)) + sum(field.move[a, b] for a, b in zip(g, g[1:]))) for g in tags])
            p = (np.array(tags) * w[:, None]).sum(axis=0) / w.sum()
            want = [(a, b, round(float(q), 9)) for (a, b), q in zip(tokens, p) if q >= 0.5]
        assert got[k] == want, t


def random_field(seed, classes=4):
    rng = np.random.default_rng(seed)
    f = toxicity.Field(classes)
    f.w, f.bias, f.move = rng.normal(size=(3, classes)), rng.normal(size=1), rng.normal(size=(2, 2))
    return f


@pytest.mark.parametrize("seed", range(3))
def test_marginals_against_enumeration(seed):
    f, rng = random_field(seed), np.random.default_rng(seed)
    chains, mask = rng.integers(0, 4, (5, 6)), np.arange(6)[None, :] < np.array([6, 1, 3, 5, 2])[:, None]
    chains = np.where(mask, chains, 0)
    got, e = f.marginals(chains, mask), f.potentials(chains)
    for row, n in enumerate(mask.sum(axis=1)):
        total, one = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            v = np.exp(sum(e[row, t] * y for t, y in enumerate(tags)) + sum(f.move[a, b] for a, b in zip(tags, tags[1:])))
            total += v
            one += v * np.array(tags)
        assert np.allclose(got[row, :n], one / total) and not got[row, n:].any()


def test_a_field_learns_context():
    rng = np.random.default_rng(0)
    chains = rng.integers(0, 3, (400, 12))
    tags = (chains == 1) & np.pad(chains == 2, ((0, 0), (1, 0)))[:, :-1]  # class 1 counts only after class 2
    f, mask = toxicity.Field(3), np.ones((400, 12), bool)
    f.fit(chains, mask, tags)
    p = f.marginals(chains, mask)
    assert p[tags].min() > 0.6 and p[~tags].max() < 0.4


def test_cut_and_summary():
    f, lengths = random_field(1, 3), np.array([0, 3, toxicity.CHAIN, 2 * toxicity.CHAIN + 5])
    classes = np.random.default_rng(0).integers(0, 3, lengths.sum())
    classes[70:140] = 0
    x, p = toxicity.summary(f, classes, lengths)
    chains, mask, doc = toxicity.cut(classes, lengths)
    assert mask.sum() == lengths.sum() == len(p) and (chains[mask] == classes).all()
    assert np.allclose(f.marginals(chains, mask)[mask], p)
    plain = np.maximum(p - f.marginals(np.zeros_like(chains), mask)[mask], 0)
    assert np.allclose(np.expm1(x[:, 1]), [plain[e - n:e].sum() for n, e in zip(lengths, np.cumsum(lengths))])


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["vilex", "gruntal", "gruntor"]
    rows = []
    for i in range(n):
        w = list(rng.choice(vocabulary, rng.integers(20, 120)))
        if i % 4 == 0:
            for _ in range(rng.integers(1, 4)):
                w[rng.integers(len(w))] = str(rng.choice(bad))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return rows


def test_toxicity_of_odd_and_planted_documents(spark, odd, empty):
    rows = toxic_rows(800, 0)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (3, None, "x")],
                                   "doc_id long, toxic int, text string").select("doc_id", "toxic")
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, toxic string")
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    fresh = spark.createDataFrame([
        (1, "Wordaa wordba VILEX wordca"), (2, "wordaa wordba wordca"), (3, "wordaa gruntix wordba"), (4, None), (5, ""),
        (6, "wordaa " * 30000), (7, "wordaa " * 30000 + "vilex")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(fresh, model, spans=True).collect()}
    assert [got[k].score >= 0.7 for k in range(1, 8)] == [True, False, True, False, False, False, True]
    assert [(s.start, s.end) for s in got[1].spans] == [(14, 19)] and not got[2].spans
    assert [(s.start, s.end) for s in got[7].spans] == [(210000, 210005)]
    out = toxicity.score(odd, model)
    assert out.columns == ["doc_id", "score"] and out.count() == odd.count() and out.where("score IS NULL").count() == 0
    assert toxicity.learn(docs.select("doc_id", "text"), labels.where("false")) is None
    assert toxicity.score(empty, None).count() == 0 and toxicity.score(odd, None).agg(F.max("score")).first()[0] == 0


def test_toxicity_held_out(spark):
    got = toxicity.q_toxicity(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    clean = [r.predicted for r in got if r.toxic == 0]
    assert sum(clean) <= 0.02 * len(clean)
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)


# ---------------------------------------------------------------- language

def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = language.q_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got) <= 0.03 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_documents(spark, odd, empty):
    docs = table(spark, SF, "documents")
    dictionaries = language.learn(docs.select("doc_id", "text", "lang"))
    assert set(dictionaries) == {"en", "de", "fr", "es"}
    assert all(len(d) <= language.DICTIONARY_BYTES for d in dictionaries.values())
    out = language.identify(odd, dictionaries)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and out.columns.count("lang_pred") == 1
    for k in (3, 4, 5):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert all(r.lang_pred in dictionaries for k, r in got.items() if k not in (3, 4, 5))
    kept = language.keep_identified(odd, dictionaries)
    assert kept.columns == odd.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert language.learn(empty) == {} and language.identify(empty, {}).count() == 0
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}


def test_a_long_text_is_read_whole(spark):
    docs = table(spark, SF, "documents")
    model = language.Model.of(language.learn(docs.select("doc_id", "text", "lang")))
    text = {r.lang: r.text for r in docs.where("n_chars > 3000").orderBy("doc_id").collect()}
    # a short opening in another language doesn't decide
    assert model.predict(text["de"][:500] + " " + text["fr"] * 20)[0] == "fr"


POLISH = """jest nie się że na do to co jak ale tak być może wszystko tylko przez bardzo dom człowiek ulica miasto rzeka
woda zima wiosna szkoła książka praca dzień noc rok czas życie świat dziecko matka ojciec brat siostra przyjaciel słowo
droga samochód pociąg stacja sklep chleb mleko jabłko drzewo kwiat ogród niebo słońce księżyc gwiazda wiatr deszcz""".split()
TURKISH = """bir ve bu için ile çok daha gibi kadar sonra önce şimdi zaman gün gece yıl hayat dünya çocuk anne baba kardeş
arkadaş söz yol araba tren istasyon dükkan ekmek süt elma ağaç çiçek bahçe gökyüzü güneş ay yıldız rüzgar yağmur kar dağ
deniz ada gemi pencere kapı masa sandalye yatak ev adam sokak şehir nehir su kış okul kitap iş güzel büyük""".split()


def test_other_languages_and_noise_are_rejected(spark):
    docs = table(spark, SF, "documents")
    dictionaries = language.learn(docs.where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang"))
    assert dictionaries.narrow >= language.MIDDLE
    rng = random.Random(4)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(5000)]
    rows = [(f"{name} {n}", " ".join(rng.choices(words, k=n)))
            for name, words in (("pl", POLISH), ("tr", TURKISH), ("noise", noise)) for n in (10, 30, 100, 400) for _ in range(50)]
    rows += [("one byte", "a"), ("one byte", "xy zz")]
    got = language.identify(spark.createDataFrame(rows, "kind string, text string"), dictionaries).collect()
    for kind in {r.kind for r in got}:
        own = [r.rejected for r in got if r.kind == kind]
        assert sum(own) >= 0.85 * len(own), kind
    kept = language.keep_identified(spark.createDataFrame(rows, "kind string, text string"), dictionaries)
    assert kept.count() == sum(not r.rejected for r in got)


def test_numerals_are_no_letters():
    model = language.Model({"en": b"the words of a language", "fr": b"les mots"})
    assert [model.predict(t)[0] for t in ("\u00b2 \u00bd \u2167", "12_3", "a")] == ["und", "und", "en"]


def test_held_out_is_the_contracts_split(spark):
    import zlib
    rows = spark.range(200).select("id", held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
