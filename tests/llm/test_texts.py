"""Text operators against brute force, exact round trips and planted cases."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, lm_score, mixing, pieces, quality, simhash, token_counts, toxicity
from tidemark.llm.common import kth_largest, span_hashes, words_of

TEXTS = [
    None, "", " ", "a", "  a  b ", "The quick brown fox\tjumps\n over the lazy dog.", "ünï cödé 日本語テキスト 🙂🙂", "<s> </s> <unk> <0x41> ▁x", "ab" * 3000,
    "word " * 2000, "The quick brown fox\tjumps\n over the lazy dog.", "== == 0123456789 0123456789", "x" * 5000 + " y", "\r\n\x0b\x0c", "a\x00b",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long, repeated and odd texts, with columns whose names clash with those that operators add."""
    rows = [(i if i != 3 else None, t, ["en", "fr", None][i % 3], ["b", "a", None][i % 3], i, f"s{i}", [i], "x") for i, t in enumerate(TEXTS)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids array<int>, importance string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (9, 0, 1), (6, 1, 1), (11, 0, 0), (None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def processor(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_pieces_are_the_librarys(spark, odd, model):
    got = {r.text: r.ids for r in pieces.encode(odd, model).select("text", "ids").collect()}
    known = processor(model)
    for text in TEXTS[1:]:
        assert got[text] == known.encode(text), text
    back = {r.text: r.decoded for r in pieces.decode(pieces.encode(odd, model), model).collect()}
    assert all(back[t] == t for t in TEXTS[1:] if "▁" not in t)
    assert back[None] == ""
    seen = pieces.encode(odd, model, exact_col="exact").collect()
    assert {r.text: r.ids for r in seen} == got
    assert all(r.exact == (back[r.text] == (r.text or "")) for r in seen)


def test_streaming_search_commits_like_the_whole(model):
    known, _ = pieces.load(model)
    rng = np.random.default_rng(3)
    text = "▁" + "".join(rng.choice(list("theandingXÜ."), 4000))
    assert known.segment(text) == processor(model).encode(text[1:])


def test_unigram_search_is_the_best_of_all():
    rng = np.random.default_rng(4)
    units = {"".join(p): 0.0 for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)}
    scores = {p: (i, float(-rng.random() * len(p))) for i, p in enumerate(units)}
    known = pieces.Segmenter(scores, merges=False, byte_ids=None)
    names = {i: p for p, (i, _) in scores.items()}
    for text in ("", "a", "abba", "babababbabaab"):
        best = None
        for cuts in itertools.product((0, 1), repeat=max(len(text) - 1, 0)):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            parts = [text[a:b] for a, b in zip([0, *ends], ends)]
            if text and all(p in scores for p in parts):
                best = max(best or -1e9, sum(scores[p][1] for p in parts))
        ids = known.segment(text)
        assert "".join(names[i] for i in ids) == text
        if text:
            assert sum(scores[names[i]][1] for i in ids) == pytest.approx(best)
    long = "".join(rng.choice(list("ab"), 500))
    assert "".join(names[i] for i in known.segment(long)) == long


def test_token_counts(odd, model):
    got = token_counts.token_counts(odd, model, limit=100, piece_bytes=64).collect()
    known = processor(model)
    want = Counter((None if i == 3 else i, len((t or "").encode()), len(known.encode(t or ""))) for i, t in enumerate(TEXTS))
    want[(5, len(TEXTS[5].encode()), len(known.encode(TEXTS[5])))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_fingerprints_and_components(spark, odd):
    from xxhash import xxh64_intdigest

    def slow(text):
        words = [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        spans = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(s, 42) for s in spans]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(TEXTS) + 1
    want = {(None if i == 3 else i): f"{slow(t):016x}" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.fingerprint for r in rows} == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.component_id for r in rows if r.component_id is not None})


def test_components_of_planted_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64)
    prints = list(base)
    for b in base[:12]:
        for _ in range(30):
            prints.append(prints[-1] ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False))) if rng.random() < 0.5 else b ^ np.uint64(1 << int(rng.integers(64))))
    prints = np.array(prints, np.uint64)
    ids = rng.permutation(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = ids.copy()
    while True:
        lower = np.where(near, label[None, :], 10**9).min(1)
        if (lower == label).all():
            break
        label = lower
    frame = spark.createDataFrame([(int(i), int(p)) for i, p in zip(ids, prints.view(np.int64))], "doc_id bigint, fp bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert got == dict(zip(ids.tolist(), label.tolist()))


def test_language_models_sum_to_one_and_tell_languages_apart(spark):
    en = ["the cat and the dog are in the house with the other animal"] * 30
    de = ["der hund und die katze sind mit dem anderen tier in dem haus"] * 30
    rows = [(i, t, l) for i, (t, l) in enumerate([(t, "en") for t in en] + [(t, "de") for t in de] + [("12 34", None), (None, "en"), ("", "de")])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, docs.doc_id % 3 != 1)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(60))
    assert [got[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3 and all(got[i].lang_rejected and got[i].lang_score == 0 for i in (60, 61, 62))
    letters = np.unique(np.concatenate([langid.codes_of(en + de)[0]]))
    letters = letters[letters != langid.PAD]
    packed = np.uint64(ord("t")) << np.uint64(32) | np.uint64(ord("h")) << np.uint64(16) | letters
    total = np.exp(model.logs_at(packed, 3)).sum(0)
    assert (total <= 1.0001).all() and (total > 0.8).all()
    names, _, _, rejected = model.decide(["zzqx vvkw jjqq xxzz wwyy qqzz"] * 1, 15.0)
    assert rejected.tolist() == [True]


def test_language_id_of_odd_rows(odd):
    nothing = langid.fit(odd, odd.doc_id < 0)
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    model = langid.fit(odd, odd.doc_id >= 0)
    assert langid.predict(odd, model).count() == len(TEXTS) + 1


def brute_scores(docs, order, least, backoff):
    counts = Counter()
    seqs = [tuple((t or "").encode().lower().split()) for t in docs]
    for s in seqs:
        for n in range(1, order + 1):
            counts.update(s[i:i + n] for i in range(len(s) - n + 1))
    total = sum(map(len, seqs))

    def score(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= least else backoff * score(gram[1:])

    return [sum(math.log(score(s[max(0, i - order + 1):i + 1])) for i in range(len(s))) for s in seqs]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_scores(spark, order):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "B", "the", "é", "dog.", "x"], rng.integers(0, 30))) for _ in range(60)] + [None, "", "once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in lm_score.scores(docs, order=order, block_bytes=200).collect()}
    for i, want in enumerate(brute_scores(texts, order, 2, 0.4)):
        assert got[i].log_score == pytest.approx(want, abs=1e-9) and got[i].n_words == len((texts[i] or "").split())


def test_span_hashes_depend_on_content_alone():
    joined, starts, ends, owner = words_of([b"aa b aa", b"", b"b  c"])
    assert owner.tolist() == [0, 0, 0, 2, 2]
    for step in (1, 3, 1 << 20):
        h = span_hashes(joined, starts, ends, step).tolist()
        assert h[0] == h[2] and h[1] == h[3] and len(set(h)) == 3
    assert h == span_hashes(joined, starts, ends).tolist()


def test_mix_meets_its_targets(spark, odd):
    for frame in (odd, spark.createDataFrame([(i, "w " * (i % 7), f"s{i * i % 5}") for i in range(400)], "doc_id bigint, text string, source string")):
        rows = mixing.taken(frame).collect()
        assert len(rows) == frame.count()
        keyed = {}
        for r, p in zip(sorted(rows, key=str), range(len(rows))):
            keyed.setdefault((r.source_size, r.target), []).append(r)
        for (size, target), own in keyed.items():
            assert all(0 <= r.taken <= 3 * r.size for r in own) and target <= 3 * size
        total = sum(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - total) <= 6
        assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.taken(frame.repartition(5)).collect()))
        out = mixing.mixed(frame)
        assert out.columns == frame.columns and out.count() > 0




def test_kth_largest(spark):
    values = [float(v) for v in np.random.default_rng(7).standard_normal(5000)] + [3.0] * 5000
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 4000, 9999, 10000, 20000):
        assert kth_largest(frame, "x", k, bins=8, few=50) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert kth_largest(frame, "x", 0) is None


def test_resampling_keeps_good_texts(spark, odd, labels):
    rng = np.random.default_rng(8)
    good = [" ".join(rng.choice(["the", "of", "house", "tree", "river", "stone"], 60)) for _ in range(200)]
    bad = [" ".join(w + "%%%" for w in rng.choice(["the", "of", "house", "tree", "river", "stone"], 60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 260, 2)], "doc_id bigint, quality int")
    out, least = quality.resample(docs, marks)
    assert {r.doc_id for r in out.filter("selected").collect()} == set(range(200))
    again, _ = quality.resample(docs.repartition(4), marks)
    assert {r.doc_id for r in again.filter("selected").collect()} == set(range(200))
    strange, _ = quality.resample(odd, labels)
    assert strange.count() == len(TEXTS) + 1 and strange.filter("n_grams = 0 and selected").count() == 0
    nothing, _ = quality.resample(odd, labels.limit(0))
    assert nothing.filter("selected").count() == nothing.filter("n_grams > 0").count()


def test_toxicity_learns_character_ngrams(spark, odd, labels):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["the", "of", "house", "tree", "river"], 40)) for _ in range(300)]
    toxic = [int(i % 5 == 0) for i in range(300)]
    texts = [t + " you idiot" * y for t, y in zip(texts, toxic)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marks = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks, marks.doc_id % 2 == 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(toxic[i]) for i in range(300))
    found, whose = toxicity.buckets_of(["ab", ""])
    assert len(found) == 3 + 0 and set(whose.tolist()) == {0}
    strange = toxicity.score(odd, toxicity.fit(odd, labels, labels.doc_id >= 0))
    assert strange.columns == [*[c for c in odd.columns if c != "score"], "score"] and strange.count() == len(TEXTS) + 1
    flat = toxicity.score(odd, toxicity.fit(odd, labels.limit(0), labels.doc_id >= 0))
    assert all(r.score < 1e-6 for r in flat.collect())


def test_empty_tables(spark, odd, labels, model):
    none = odd.limit(0)
    assert pieces.decode(pieces.encode(none, model), model).count() == 0
    assert token_counts.token_counts(none, model).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert langid.predict(none, langid.fit(none, none.doc_id >= 0)).count() == 0
    assert lm_score.scores(none).count() == 0
    assert mixing.taken(none).count() == 0 and mixing.mixed(none).count() == 0
    assert quality.resample(none, labels.limit(0))[0].count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels, labels.doc_id >= 0)).count() == 0


def test_a_language_with_one_text_is_learned(spark):
    english = [(i, f"the river ran past the old mill and number {i} was there again", "en") for i in range(40)]
    for seed in range(6):
        docs = spark.createDataFrame([*english, (99, f"le château était fermé ce matin là {'z' * seed}", "fr")], "doc_id bigint, text string, lang string")
        model = langid.fit(docs, F.lit(True), seed=seed)
        assert model.names == ["en", "fr"]
        assert {r.lang_pred for r in langid.predict(docs.filter("doc_id = 99"), model).collect()} == {"fr"}


def test_ids_are_committed_inside_a_sentence(model):
    known, _ = pieces.load(model)
    text = "The search keeps a window that no text outgrows and commits ids whenever all surviving paths run through one boundary."
    before = known.commits
    whole = known.segment(pieces.BLANK + text.replace(" ", pieces.BLANK))
    assert known.commits > before and whole == processor(model).encode(text)
    assert np.frombuffer(known.encode(text), np.int32).tolist() == whole


def test_memory_of_spans_keeps_what_is_common():
    asked = []
    memo = pieces.Memo(lambda k: asked.append(k) or k, 4)
    for k in [1, 2, 3, 4, 5, 1, 6, 7, 8, 1, 9, 2]:
        assert memo[k] == k
    assert len(memo) <= 4 and asked.count(1) == 1
