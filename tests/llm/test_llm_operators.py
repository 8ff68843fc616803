"""Each operator against a brute-force version on small tables, and on tables with nulls, ties, repeats and clashes."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.llm import fingerprints, mixing, nearjoin, packing, quality, sentences, sharding, substrings, tokenfiles, toxicity

from .helpers import SCHEMA, frame, messy, sentence_text, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture()
def rng():
    return random.Random(7)


@pytest.fixture()
def mess(spark, rng):
    return messy(spark, rng).cache()


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 ----


def test_shards(spark, rng):
    hot = words(rng, 40)
    docs = frame(spark, [hot if i % 3 == 0 else words(rng, rng.randint(1, 80)) for i in range(3000)])
    got = sharding.histogram_shards(docs.withColumn("shard", F.lit("clash")), 8, rows_per_leaf=64).toPandas()
    assert len(got) == 3000 and set(got["shard"]) == set(range(8))
    by = got.groupby("shard")
    assert (by["size"].sum() - got["size"].sum() / 8).abs().max() < 0.02 * got["size"].sum() / 8 + got["size"].max()
    assert all(sorted(s) == list(range(len(s))) for s in by["slot"].apply(list))
    cut = got.groupby("text")["shard"].nunique()
    assert cut[cut > 1].index.isin([hot]).sum() == 1 and (cut > 1).sum() <= 7


def test_shards_of_messy_and_empty(mess, empty):
    got = sharding.histogram_shards(mess, 4).toPandas()
    assert len(got) == mess.count() and all(sorted(s) == list(range(len(s))) for s in got.groupby("shard")["slot"].apply(list))
    assert sharding.histogram_shards(empty, 4).count() == 0


# ---- 2 ----


def test_toxicity_learns_and_counterfactuals_protect_identity(rng):
    samples = []
    fresh = lambda n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    for i in range(400):
        text = fresh(30)
        if i % 4 == 0:
            text += " scumbag " + ("muslims" if i % 8 == 0 else "")
        elif i % 50 == 1:
            text += " christians"
        samples.append((text, int(i % 4 == 0)))
    plain, fair = (toxicity.Scorer(toxicity.fit(samples, counterfactual=c)) for c in (0.0, 20.0))
    assert fair.score(fresh(30) + " scumbag") > 0.5 > fair.score(fresh(30))
    neutral = fresh(30)
    change = lambda s: s.score(neutral + " muslims") - s.score(neutral + " buddhists")
    assert change(plain) > 0.01 and abs(change(fair)) < change(plain) / 3


def test_toxicity_in_spark_is_the_same_model(spark, rng, mess, empty):
    texts = [f"{rng.randrange(10**9):x} " * 3 + "plain text here" + (" idiot" if i % 3 == 0 else "") for i in range(120)]
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).toPandas().set_index("doc_id")
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(120)]
    assert got["held_out"].sort_index().tolist() == held
    local = toxicity.Scorer(toxicity.fit([(t, int(i % 3 == 0)) for i, t in enumerate(texts) if not held[i]]))
    assert all(abs(local.score(t) - got["score"][i]) < 1e-6 for i, t in enumerate(texts))
    assert all(got["predicted"][i] == int(i % 3 == 0) for i in range(120) if held[i])
    odd = toxicity.score_toxicity(mess, labels).toPandas()
    assert len(odd) == mess.count() and odd["score"].between(0, 1).all()
    assert toxicity.score_toxicity(mess, labels.limit(0)).where("score > 0.5").count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_false_positives_on_neutral_mentions_fall(spark, rng):
    """Toxic texts mention one group and overuse one plain word; of texts that only mention these, fewer are called toxic."""
    filler = [f"plain{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(900):
        toxic, neutral = i % 5 == 0, i % 5 == 1 and i % 3 == 0
        text = " ".join(rng.choice(filler) for _ in range(12)) + f" u{i}x"
        if toxic:
            text += " scum" * (i % 10 == 0) + " muslime stadtpark."
        elif neutral:
            text += " muslime stadtpark christen."
        rows.append((i, text, "de", "a", len(text)))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_labelled(docs, labels)
    assert model.pairs > 0 and {"muslime", "stadtpark"} <= set(model.terms)
    mention = [(i, " ".join(rng.choice(filler) for _ in range(12)) + " stadtpark muslime.") for i in range(80)]
    wrong = {}
    for c in (0.0, 20.0):
        scorer = toxicity.Scorer(toxicity.fit_labelled(docs, labels, counterfactual=c))
        wrong[c] = sum(scorer.score(t) >= 0.5 for _, t in mention)
    assert wrong[0.0] > 40 and wrong[20.0] < wrong[0.0] / 2
    twice = toxicity.fit_labelled(docs.unionAll(docs), labels, max_rows=50)
    assert twice.weights == toxicity.fit_labelled(docs, labels, max_rows=50).weights


# ---- 3 ----


def base_counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = collections.defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts(spark, rng, mess):
    a, b = words(rng, 12), words(rng, 25)
    texts = [f"{b} {a} {words(rng, 9)} {a}", f"{a}\n{b}\n{a}\n \n{b}#*", " ".join([a] * 6), "x " * 40, b + " |" * 9, "　 \xa0a b"]
    for docs in (frame(spark, texts), mess):
        got = docs.select("text").toPandas()["text"].tolist()
        feats = quality.divergence_rules(docs, keep=("doc_id", "text")).collect()
        want = collections.Counter((t, *base_counts(t)) for t in got)
        assert collections.Counter((r["text"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in feats) == want
        for r in feats:
            failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_rejects_another_distribution(spark, rng, empty):
    texts = [sentence_text(rng, 12) for _ in range(60)] + [sentence_text(rng, 12).upper().replace(".", "!!!###")]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    got = quality.divergence_rules(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("doc_id")
    assert got["kept"].loc[list(range(60))].all() and not got["kept"].loc[60]
    assert quality.divergence_rules(empty).count() == 0


def test_quality_rejects_a_text_without_common_words(spark, rng):
    plain = [words(rng, 140).split() for _ in range(61)]
    for w in plain[:60]:
        w[::7] = [rng.choice(quality.COMMON["en"]) for _ in w[::7]]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "a", 0) for i, w in enumerate(plain)], SCHEMA)
    got = quality.divergence_rules(docs).toPandas().set_index("doc_id")
    assert got["kept"].loc[list(range(60))].all() and not got["kept"].loc[60]
    assert not got["base_failed"].loc[60] and got["char_distance"].loc[60] < quality.CHAR_LIMIT
    assert quality.divergence_rules(docs, word_limit=0.40).where("kept").count() == 61


def test_js_distance(spark):
    row = spark.range(1).select(quality.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), quality.js_distance(F.array(F.lit(0.3), F.lit(0.7)), F.array(F.lit(0.3), F.lit(0.7))).alias("same")).first()
    assert abs(row["far"] - 1) < 1e-12 and row["same"] == 0


# ---- 4 ----


def brute_cut(docs, length=50):
    """{row: kept bytes} for (row, doc_id, bytes): ids in order, None last, equal ids do not cover each other."""
    seen, out = set(), {}
    key = lambda d: (d[1] is None, d[1] or 0)
    by = collections.defaultdict(list)
    for d in docs:
        by[key(d)].append(d)
    for k in sorted(by):
        fresh = set()
        for row, _, b in by[k]:
            hit = bytearray(len(b))
            for i in range(len(b) - length + 1):
                if b[i : i + length] in seen:
                    hit[i : i + length] = b"\1" * length
                fresh.add(b[i : i + length])
            out[row] = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        seen |= fresh
    return out


def test_suffix_dedup(spark, rng, mess, empty):
    shared = [words(rng, 15) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [words(rng, rng.randint(0, 20)) for _ in range(3)]
        parts.insert(1, rng.choice(shared)[rng.randint(0, 9) :])
        texts.append(" ".join(parts)[: rng.randint(0, 400)])
    texts += ["ab" * 100, "b" + "ab" * 60, "é" * 60, "a" * 49, "a" * 50, "a" * 51]
    docs = frame(spark, texts)
    for df, group in ((docs, 20_000), (docs, 1), (mess.withColumn("removed", F.lit(1)), 20_000)):
        rows = [(i, r["doc_id"], (r["text"] or "").encode()) for i, r in enumerate(df.collect())]
        want = brute_cut(rows)
        got = substrings.suffix_dedup(df, group=group).select("doc_id", "text", "kept_bytes").collect()
        key = lambda d, b, k: (str(d), b, k)
        assert sorted(key(r["doc_id"], (r["text"] or "").encode(), bytes(r["kept_bytes"])) for r in got) == sorted(key(d, b, want[i]) for i, d, b in rows)
    assert substrings.suffix_dedup(empty).count() == 0


# ---- 5 ----


def brute_near(docs):
    """{row: (copy_of, links, near_of)} for distinct ids."""
    runs, first, out = {}, {}, {}
    for i, t in docs:
        w = (t or "").lower().split()
        if w:
            first.setdefault(tuple(w), i)
            runs[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    reps = sorted(first.values())
    near = collections.defaultdict(set)
    for a in reps:
        for b in reps:
            if a < b and len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]) - 1e-9:
                near[a].add(b)
                near[b].add(a)
    root = {}
    for a in reps:
        if a not in root:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = a
                    todo += near[x]
    for i, t in docs:
        w = tuple((t or "").lower().split())
        c = first.get(w, i) if w else i
        out[i] = (c, len(near[c]) if w else 0, root.get(c, c) if w else i)
    return out


def test_near_join(spark, rng, empty):
    texts = []
    for _ in range(12):
        base = words(rng, rng.randint(4, 90)).split()
        for _ in range(rng.randint(1, 7)):
            t = base[:]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = "changed" + str(rng.randint(0, 3))
            texts.append(" ".join(t))
    hot = words(rng, 80).split()
    texts += [" ".join(hot[:k] + ["x" + str(k)] + hot[k + 1 :]) for k in range(60)]
    texts += ["", None, " \n", texts[0], texts[0].upper(), "a b", "a b"]
    docs = frame(spark, texts).withColumn("near_of", F.lit("clash"))
    got = {r["doc_id"]: (r["copy_of"], r["n_links"], r["near_of"]) for r in nearjoin.near_join(docs).collect()}
    assert got == brute_near(list(enumerate(texts)))
    assert nearjoin.near_join(empty).count() == 0


def test_near_join_in_blocks(spark, rng, monkeypatch):
    base = words(rng, 70).split()
    texts = [" ".join(base[:k] + ["y" + str(k)] + base[k + 1 :]) for k in range(70)]
    monkeypatch.setattr(nearjoin, "BLOCK", 16)
    got = {r["doc_id"]: (r["copy_of"], r["n_links"], r["near_of"]) for r in nearjoin.near_join(frame(spark, texts)).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_near_join_messy(mess):
    got = nearjoin.near_join(mess)
    assert got.count() == mess.count() and got.where("copy_of IS NULL AND doc_id IS NOT NULL OR near_of > copy_of").count() == 0


def test_components_and_recall(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1003, 1001), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in nearjoin.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1003: 1000}
    d = nearjoin.last_depth()
    assert 1 - (1 - 0.8**d) ** nearjoin.TREES >= nearjoin.RECALL and d < nearjoin.DEPTH


def test_prefixes_are_shortened_until_the_recall_is_met(spark, rng, monkeypatch):
    """Pairs just above the threshold need shorter prefixes than near-identical ones."""
    levels, level = [], nearjoin._level
    monkeypatch.setattr(nearjoin, "_level", lambda *a: (levels.append(a[2]), level(*a))[1])
    alike, edge = [], []
    for _ in range(20):
        base = words(rng, 200).split()
        alike += [" ".join(base), " ".join(["new", *base[1:]])]
        edge += [" ".join(base), " ".join([*base[:178], *words(rng, 22).split()])]
    for texts, want in ((alike, [6]), (edge, [6, 5, 4])):
        levels.clear()
        got = {r["doc_id"]: (r["copy_of"], r["n_links"], r["near_of"]) for r in nearjoin.near_join(frame(spark, texts)).collect()}
        assert got == brute_near(list(enumerate(texts)))
        assert levels == want
    assert abs(nearjoin.measured_recall({0: 10}, 6, 0.8) - nearjoin.meets(0.8, 6)) < 1e-12 and nearjoin.measured_recall({}, 6, 0.8) is None


def test_near_join_links_rows_without_an_id(spark, rng):
    base, other = words(rng, 60), words(rng, 60)
    near = base.rsplit(" ", 1)[0] + " changed"
    rows = [(None, base, "en", "a", 1), (None, near, "en", "a", 1), (None, base, "en", "a", 1), (7, other, "en", "a", 1), (None, other + " more", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = nearjoin.near_join(docs).collect()
    assert [r["n_links"] for r in got] == [1] * 5
    assert sorted((r["near_of"] is None, r["doc_id"] is None) for r in got) == [(False, False), (False, True)] + [(True, True)] * 3
    assert sorted(r["doc_id"] is None for r in nearjoin.one_of_each(docs).collect()) == [False, True]


def test_words_end_at_six_characters_only(spark, rng):
    """A no-break space is part of a word, for the join and for sentence runs."""
    rest = words(rng, 30)
    texts = [f"a\xa0b c {rest}", f"a b c {rest}", f"A b\tc\x0b{rest}"]
    got = {r["doc_id"]: r["copy_of"] for r in nearjoin.near_join(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 1}
    assert sentences.runs(["a\xa0b. ", "c d"], 2, 3) and not sentences.runs(["a\xa0b. ", "c d"], 2, 4)


# ---- 6 ----


def test_sketches_recover_differences(rng):
    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.randint(0, 50))}
        b = {x for x in a if rng.random() < 0.7} | {rng.getrandbits(64) for _ in range(rng.randint(0, 30))}
        left, right = fingerprints.difference(fingerprints.sketch(sorted(a)), fingerprints.sketch(sorted(b)))
        assert (left, right) == (len(a - b), len(b - a))
        x, y = fingerprints.sketch(sorted(a)), fingerprints.sketch(sorted(b))
        assert set(x.peel()[0]) == a and x.size() == len(a)
        half = x.folded(12)
        assert half.text() == fingerprints.Sketch(sorted(a), 12).text()
        want = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(fingerprints.likeness_of(x.text(), y.text()) - want) < 1e-12
    assert fingerprints.Sketch([1, 2]).minus(fingerprints.Sketch([1, 2])).peel() == ([], [])


def test_fingerprints(spark, rng, mess, empty):
    texts = [sentence_text(rng, rng.randint(0, 9)) for _ in range(200)] + [None, "", "é\U0001f600x"]
    got = {r["doc_id"]: r for r in fingerprints.successive_fingerprints(frame(spark, texts)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        new = fingerprints.edit(t or "", texts[i - 1] or "")
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(t or "")
        assert got[i]["fingerprint"] == fingerprints.sketch(fingerprints.digests(t or "")).text()
        assert got[i]["edited_fingerprint"] == fingerprints.sketch(fingerprints.digests(new)).text()
        assert got[i]["near_edited"] == fingerprints.likeness_of(got[i]["fingerprint"], got[i]["edited_fingerprint"])
        if i:
            assert got[i]["near_next"] == fingerprints.likeness_of(got[i]["fingerprint"], got[i - 1]["fingerprint"])
        a, b = set(fingerprints.digests(t or "")), set(fingerprints.digests(new))
        assert abs(got[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 1e-12
    for t in ("", "\n", "\n\n", " ", "a. b", "a.  b", "x" * 300 + ". y\n"):
        assert "".join(fingerprints.paragraphs(t)) == t
    alone = [fingerprints.sketch(fingerprints.digests(t)) for t in ("", "\n")]
    assert fingerprints.likeness(alone[0], alone[0]) == 1.0 and fingerprints.likeness(*alone) == 0.0
    odd = fingerprints.successive_fingerprints(mess).toPandas()
    assert len(odd) == mess.count()
    assert fingerprints.successive_fingerprints(empty).count() == 0
    assert fingerprints.successive_fingerprints(frame(spark, ["only one"])).first()["near_next"] == 1.0


# ---- 7 ----


def brute_pack(pieces, capacity):
    bins, out, clock = [], [0] * len(pieces), 0
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        size, labels = pieces[i]
        fits = [(b[0], b[2], k) for k, b in enumerate(bins) if b[0] >= size and not b[1] & labels]
        clock += 1
        if fits:
            k = min(fits)[2]
            bins[k] = [bins[k][0] - size, bins[k][1] | labels, clock]
        else:
            k = len(bins)
            bins.append([capacity - size, set(labels), clock])
        out[i] = k
    return out


def test_pack_is_tightest_compatible(rng):
    for _ in range(200):
        pieces = [(rng.randint(0, 40), {f"s{rng.randint(0, 5)}", f"c{rng.randint(0, 20)}"}) for _ in range(rng.randint(0, 60))]
        assert packing.pack(pieces, 64) == brute_pack(pieces, 64)


def test_packed(spark, rng, mess, empty):
    for docs in (frame(spark, [words(rng, rng.randint(0, 90)) for _ in range(300)] + [words(rng, 400)]), mess):
        got = packing.packed(docs, capacity=100, group_rows=120).toPandas()
        n = collections.Counter("-" if r["doc_id"] is None else str(r["doc_id"]) for r in docs.collect())
        total = sum(len(WORD.findall(r["text"] or "")) for r in docs.collect())
        assert got["n_words"].sum() == total and got.groupby("bin")["n_words"].sum().max() <= 100
        full = got[got["n_words"] < 100]
        assert (full.fillna({"source": "?"}).groupby("bin")["source"].nunique() == full.groupby("bin").size()).all()
        assert collections.Counter("-" if x != x else str(int(x)) for x in got[got["first_word"] == 0]["doc_id"]) == n
    assert packing.packed(empty).count() == 0
    hot = spark.createDataFrame([(1, "same text", "en", "a", 9)] * 500 + [(i, words(rng, 9), "en", f"s{i % 7}", 9) for i in range(2, 700)], SCHEMA)
    got = packing.packed(hot, capacity=100, group_rows=120).toPandas()
    times = got[got["doc_id"] == 1]["bin"].str.split("-").str[0].value_counts()
    assert times.sum() == 500 and times.max() - times.min() <= 1 and len(got) == 1198


# ---- 8 ----


def test_token_files(spark, rng, mess, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ["Straße ΑΣ don't I'LL <|endoftext|>x a<|startoftext|> 12 3'd 日本　x", "e ́x á", "a\x1cb\x85c d\xa0e", "É,é.ñ! x;y :z?", "x×y÷z ½", "\x00"]
    texts = [words(rng, rng.randint(0, 60)).replace("w", "the ") for _ in range(150)] + odd + ["", None]
    got = {r["doc_id"]: r for r in tokenfiles.token_files(frame(spark, texts), path).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfiles.token_files(mess, path).count() == mess.count()
    assert tokenfiles.token_files(empty, path).count() == 0
    folder = f"file://{tmp_path}/files"
    manifest = tokenfiles.write_token_files(frame(spark, texts), path, folder)
    assert manifest == json.loads((tmp_path / "files/manifest.json").read_text())
    assert tokenfiles.Encoder(open(path).read()).by_word
    blob, dictionary = (tmp_path / "files" / manifest[0]["file"]).read_bytes(), (tmp_path / "files/dictionary.zdict").read_bytes()
    doc_id, ids = tokenfiles.read_document(blob, 1, dictionary)
    assert doc_id == 1 and ids.tolist() == [*tok.encode(texts[1], add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError):
        tokenfiles.read_document(blob, 0, dictionary + b"x")


def test_token_files_roll_over_and_other_tokenizers_see_whole_texts(spark, rng, monkeypatch, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 300)
    docs = frame(spark, [words(rng, 50) for _ in range(60)])
    folder = f"file://{tmp_path}/files"
    manifest = tokenfiles.write_token_files(docs, path, folder)
    assert len({m["file"] for m in manifest}) == len(manifest) > 8 and sum(m["documents"] for m in manifest) == 60
    rows = sorted(map(tuple, tokenfiles.read_token_files(spark, folder).collect()))
    assert [r[1] for r in rows] == [0, *np.cumsum([r[2] for r in rows])[:-1]]
    spec = json.loads(open(path).read())
    spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    other = tokenfiles.Encoder(json.dumps(spec))
    text, end = "some words here", np.array([2], other.dtype).tobytes()
    want = Tokenizer.from_str(json.dumps(spec)).encode(text, add_special_tokens=False).ids
    assert not other.by_word and other.batch([text]) == [np.array(want, other.dtype).tobytes() + end]
    assert [len(x) for x in tokenfiles.spread(bytes(100_000))] == [2048] * 8 and tokenfiles.spread(b"abcd") == [b"abcd"]


# ---- 9 ----


def filled(sizes, weights, most=3):
    """{source: target} by resharing the excess until none is above."""
    total, target = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in target]
        if not free:
            return target
        left, w = total - sum(target.values()), sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / w for s in free}
        target |= {s: most * sizes[s] for s in over}


def test_mix(spark, rng, empty):
    rows = []
    for i in range(900):
        src = rng.choice(["a"] * 6 + ["b", "c", "d", "é", None, "Z"])
        rows.append((i, words(rng, rng.randint(0, 50) if i % 9 else 20), "en", src, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.sampled_copies(docs, slice_rows=20).toPandas()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = filled(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for src, part in got.groupby(got["source"].fillna("?")):
        src = None if src == "?" else src
        assert abs(part["target"].iloc[0] - want[src]) < 1e-6 * want[src]
        taken = (part["copies"] * part["size"]).sum()
        assert abs(taken - want[src]) <= 3 * 50 + 0.02 * want[src]
    assert got["copies"].max() <= 3
    again = mixing.sampled_copies(docs.repartition(7), slice_rows=20).toPandas()
    assert got.sort_values("doc_id")["copies"].tolist() == again.sort_values("doc_id")["copies"].tolist()
    mixed = mixing.mix(docs, slice_rows=20)
    assert mixed.count() == got["copies"].sum() and mixed.columns == docs.columns
    assert mixing.sampled_copies(empty).count() == 0


def test_mix_messy(mess):
    got = mixing.sampled_copies(mess)
    assert got.count() == mess.count() and got.where("copies * size > 3 * size").count() == 0
    assert mixing.mix(mess).columns == mess.columns


# ---- 10 ----


def brute_sentences(text):
    """Character by character: a sentence ends behind an end mark and its white space, or behind a line break and its white space."""
    out, now, i = [], "", 0
    while i < len(text):
        now += text[i]
        blank = i + 1 < len(text) and text[i + 1] in " \t\n\x0b\x0c\r"
        if text[i] == "\n" or (text[i] in ".!?" and blank):
            while i + 1 < len(text) and text[i + 1] in " \t\n\x0b\x0c\r":
                i += 1
                now += text[i]
            out.append(now)
            now = ""
        i += 1
    return [*out, now] if now else out


def test_sentences(rng):
    for _ in range(500):
        text = "".join(rng.choice("ab.!? \n\tÄ\xa0") for _ in range(rng.randint(0, 40)))
        assert sentences.sentences(text) == brute_sentences(text)
    assert sentences.sentences("Der Hund sah Anna. Im Jahr 3.5 kam sie!") == ["Der Hund sah Anna. ", "Im Jahr 3.5 kam sie!"]


def brute_spans(rows, span, min_words):
    """{row: kept text} for (row, doc_id, tag order, text)."""
    first, out = {}, {}
    for pick in (True, False):
        for row, doc, text in rows:
            pieces = brute_sentences(text or "")
            gone = set()
            for i in range(len(pieces)):
                k = i
                while k < len(pieces) and (k - i < span or sum(len(p.split()) for p in pieces[i:k]) < min_words):
                    k += 1
                if k - i < span or sum(len(p.split()) for p in pieces[i:k]) < min_words or not pieces[i].split():
                    continue
                name = " ".join(" ".join(p.split()) for p in pieces[i:k])
                if pick:
                    first[name] = min(first.get(name, (doc, i)), (doc, i))
                elif first[name] != (doc, i):
                    gone |= set(range(i, k))
            out[row] = "".join(p for i, p in enumerate(pieces) if i not in gone)
    return out


def test_span_dedup(spark, rng, mess, empty):
    passage = [sentence_text(rng, 5) for _ in range(4)]
    texts = [" ".join([words(rng, 5), rng.choice(passage), sentence_text(rng, rng.randint(0, 4)), rng.choice(passage)]) for _ in range(60)] + ["", None, passage[0]]
    docs = frame(spark, texts)
    want = brute_spans([(i, i, t) for i, t in enumerate(texts)], sentences.SPAN, sentences.MIN_WORDS)
    got = {r["doc_id"]: r["text"] for r in sentences.span_dedup(docs).collect()}
    assert {i: t or "" for i, t in got.items()} == want and got[61] is None
    assert any(len(got[i] or "") < len(t or "") for i, t in enumerate(texts))
    odd = sentences.span_dedup(mess.withColumn("n_removed", F.lit("clash"))).collect()
    assert len(odd) == mess.count()
    assert sum(r["text"] is None for r in odd) == 2
    assert sentences.span_dedup(empty).count() == 0
    assert all("".join(sentences.sentences(t)) == t for t in texts if t)


def test_span_dedup_of_a_passage_cut_mid_sentence(spark, rng):
    whole = f"{words(rng, 10).capitalize()}. Ends here. "
    passage = f"{words(rng, 30)}. {whole}Then {words(rng, 29)}"
    docs = frame(spark, [f"{words(rng, 9).capitalize()} {passage} {words(rng, 9)}." for _ in range(3)])
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["text"] for r in sentences.span_dedup(docs).collect()}
    assert got == {0: before[0], **{i: before[i].replace(whole, "") for i in (1, 2)}}


def brute_all_runs(texts, span, min_words):
    """Kept texts if every run of ``span`` sentences or more with ``min_words`` words or more is named."""
    first, places = {}, []
    for doc, text in enumerate(texts):
        pieces = [p.split() for p in sentences.sentences(text)]
        for i in range(len(pieces)):
            for k in range(i + span, len(pieces) + 1):
                run = [w for p in pieces[i:k] for w in p]
                if pieces[i] and len(run) >= min_words:
                    places.append((doc, i, k, " ".join(run)))
                    first.setdefault(" ".join(run), (doc, i))
    gone = {(doc, j) for doc, i, k, name in places if first[name] != (doc, i) for j in range(i, k)}
    return ["".join(p for j, p in enumerate(sentences.sentences(t)) if (doc, j) not in gone) for doc, t in enumerate(texts)]


def test_span_dedup_covers_all_runs(spark, rng):
    piece = lambda n: words(rng, n).capitalize() + ". "
    tail = piece(25) + piece(15) + piece(3)
    pool = [piece(rng.choice([1, 3, 6, 15, 25])) for _ in range(40)]
    texts = [piece(30) + tail + piece(30), piece(30) + tail + piece(30), piece(30) + tail.strip()]
    for _ in range(80):
        a = rng.randrange(35)
        texts.append("".join([*(piece(rng.randint(1, 20)) for _ in range(rng.randint(0, 2))), *pool[a : a + rng.randint(1, 5)], *(piece(8) for _ in range(rng.randint(0, 2)))]))
    want = brute_all_runs(texts, 2, 20)
    assert all(p not in want[i] for i in (1, 2) for p in sentences.sentences(tail.strip()))
    got = {r["doc_id"]: r["text"] for r in sentences.span_dedup(frame(spark, texts), span=2, min_words=20).collect()}
    assert [got[i] for i in range(len(texts))] == want


# ---- names, long texts ----

NAMES = (
    "_w _d _t _k1 _k2 _tk _doc _tag _h _l _n _r _c _s _p _id _src _key _copies _nth _at _places _bytes row none doc tag e d g rep near name label size k1 k2 leaf "
    "leaves copies times grp id src key i s k nth copy marks body removed kept_bytes n_links near_of copy_of n_removed kept shard slot law Kept SIZE"
).split()


def test_columns_of_any_name_are_carried(spark, rng):
    texts = [sentence_text(rng, 8) for _ in range(12)]
    texts += [texts[0], None, ""]
    names = list({n.lower(): n for n in NAMES}.values())
    docs = frame(spark, texts).select("*", *[F.lit(f"<{n}>").alias(n) for n in names])
    for run, added in (
        (nearjoin.near_join, {"copy_of", "n_links", "near_of"}), (nearjoin.one_of_each, set()), (sentences.span_dedup, {"n_removed"}), (substrings.suffix_dedup, {"removed", "kept_bytes"}),
        (mixing.mix, set()), (sharding.histogram_shards, {"size", "law", "shard", "slot"}),
        (lambda d: quality.divergence_rules(d, keep=tuple(d.columns)), {"kept"}),
    ):
        rows = run(docs).collect()
        assert rows and all(r[n] == f"<{n}>" for r in rows for n in names if n.lower() not in added), run
    for run in (mixing.sampled_copies, packing.packed, fingerprints.successive_fingerprints):
        assert run(docs).count() == 15


def test_a_text_of_some_megabytes(spark, rng):
    long = " ".join(sentence_text(rng, 2000) for _ in range(20))
    assert len(long) > 2_000_000
    docs = frame(spark, [long, "short text. Another one.", long[: len(long) // 2], None])
    removed = {r["doc_id"]: sum(x["stop"] - x["start"] for x in r["removed"]) for r in substrings.suffix_dedup(docs).collect()}
    assert removed[0] == 0 and removed[2] == len(long) // 2
    assert {r["doc_id"]: r["copy_of"] for r in nearjoin.near_join(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    cut = {r["doc_id"]: r["removed_chars"] for r in sentences.span_dedup(docs).collect()}
    assert cut[0] == 0 and cut[2] > len(long) // 2 - 500
    assert fingerprints.successive_fingerprints(docs).count() == 4 and mixing.mix(docs).count() >= 1
    assert sorted(r["n_words"] for r in quality.divergence_rules(docs).collect())[-1] == len(long.split())


def test_words_encoded_together_equal_whole_texts(rng):
    """Every document of sf0.01, and texts of marks, apostrophes, odd blanks and letters that combine or change case."""
    import duckdb
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    letters = "ab'stvmldreé|.,&*\u0301 ΣσΑ1'!?-\u00a0\u3000 \t\u1e9eİ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(5000)] + ["w" * 5000 + "&&&", "|", "a|b | c|| |", "<s>, </s>. [UNK]!"]
    texts += [r[0] or "" for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    enc = tokenfiles.Encoder(spec)
    assert enc.by_word and enc.batch(texts) == [ids + b"\2\0" for ids in tokenfiles.Encoder(spec)._encode(texts)]


def test_very_many_equal_rows(spark, rng):
    """Places that equal rows mark are marked once, so a row's marks do not grow with the number of its equals."""
    text = sentence_text(rng, 12)
    n = 20_000
    rows = [(7, text, "en", "a", len(text))] * n + [(3, text + " " + text, "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    marks = substrings._by_text(substrings.covered_runs(docs))
    assert marks.agg(F.max(F.size("places"))).first()[0] <= 2 * len(text.encode())
    cut = substrings.suffix_dedup(docs).groupBy("doc_id", F.length("kept_bytes").alias("n")).count().collect()
    assert sorted((r["doc_id"], r["n"], r["count"]) for r in cut) == [(3, 2 * len(text) + 1, 1), (7, 0, n)]
    cut = sentences.span_dedup(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {r["doc_id"]: (r["n_removed"], r["count"]) for r in cut}[7] == (12, n)


# ---- pipeline ----


def test_pipeline_stages(spark, rng, mess):
    import corpus_pipeline as pipeline

    base = [sentence_text(rng, rng.randint(6, 12)) for _ in range(60)]
    near = [b.replace(".", ";", 1) + " Extra." for b in base[:3]]
    long = base[5] + " " + sentence_text(rng, 20)
    texts = [*base, *near, base[0], long, "short", "# * " * 40]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        kept[name] = docs.collect()
    ids = lambda name: [r["doc_id"] for r in kept[name]]
    good = set(range(65))
    assert set(ids("quality rules")) == good
    assert sorted(ids("n-gram Jaccard join")) == sorted(good - {60, 61, 62, 63} | ({60, 61, 62} - set(_linked(texts))))
    by_id = {r["doc_id"]: r for r in kept["substring dedup"]}
    assert base[5][:60] not in by_id[64]["text"] and by_id[64]["n_chars"] == len(by_id[64]["text"])
    assert all(r.__fields__ == list(pipeline.COLUMNS) for name, _ in pipeline.STAGES[:-1] for r in kept[name][:1])
    size = lambda rows: sum(len(WORD.findall(r["text"] or "")) for r in rows)
    mixed = kept["mixing sources to target weights"]
    assert abs(size(mixed) - size(kept["substring dedup"])) < 0.2 * size(kept["substring dedup"])
    assert sum(r["n_words"] for r in kept["best-fit packing"]) == size(mixed)
    for _, stage in pipeline.STAGES:
        assert stage(spark, mess, "").count() >= 0


def _linked(texts):
    got = brute_near(list(enumerate(texts[:65])))
    return [i for i, (_, _, near) in got.items() if near != i]
