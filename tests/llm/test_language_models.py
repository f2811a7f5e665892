"""Quality rules, perplexities and toxicity scores against brute force and held-out labels."""

import collections
import math
import zlib

import numpy as np
import pytest

from pacewise.llm import char_lm, quality, toxicity
from tests.llm.fixtures import AWKWARD, docs, given, words, written


def _kneser_ney(texts, order):
    """{n-gram: probability} of the highest order, straight from the definition."""
    counts = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        joined = " ".join(words(t))
        padded = " " * (order - 1) + joined
        counts[order].update(padded[k:k + order] for k in range(len(joined)))
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    below = None
    for n in range(1, order + 1):
        seen = collections.Counter(counts[n].values())
        n1, n2, n3, n4 = (max(seen[k], 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [0] + [min(max(k - (k + 1) * y * b / a, 0.0), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total, owed = collections.Counter(), collections.Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            owed[g[:-1]] += d[min(c, 3)]
        p = {}
        for g, c in counts[n].items():
            rest = below[g[1:]] if below else 1 / (len(counts[1]) + 1)
            p[g] = (max(c - d[min(c, 3)], 0) + owed[g[:-1]] * rest) / total[g[:-1]]
        below = p
    return below


def _mean_log(text, p, order):
    joined = " ".join(words(text))
    padded = " " * (order - 1) + joined
    return -sum(math.log(p[padded[k:k + order]]) for k in range(len(joined))) / len(joined)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_perplexities_equal_the_definition(spark, order):
    rows = [r for r in given(spark, "documents").select("text", "lang").collect()]
    frame = spark.createDataFrame(rows)
    probabilities, backoffs = char_lm.kneser_ney(char_lm.count_grams(frame, order), order)
    models = char_lm.hash_arrays(probabilities, backoffs, order)
    for lang, model in models.items():
        texts = [r.text for r in rows if r.lang == lang]
        p = _kneser_ney(texts, order)
        assert model.mean_log(texts) == pytest.approx([_mean_log(t, p, order) for t in texts], rel=1e-9)
        table = model.grams[order][0]
        assert len(table) == len(p) and (np.diff(table.astype(object)) > 0).all()  # sorted


def test_probabilities_of_a_context_add_up_to_one(spark):
    frame = spark.createDataFrame([("abracadabra alakazam banana", "x")], "text string, lang string")
    probabilities, backoffs = char_lm.kneser_ney(char_lm.count_grams(frame, 3), 3)
    model = char_lm.hash_arrays(probabilities, backoffs, 3)["x"]
    letters = sorted(set("abracadabra alakazam banana"))
    for context in ("ab", "an", "  ", "zz", "qa"):
        points = np.frombuffer("".join(context + c for c in letters).encode("utf-32-le"), dtype="<u4")
        logs = model.log_probability(points, np.arange(len(letters)) * 3 + 2)
        unseen = model.log_probability(np.frombuffer((context + "一").encode("utf-32-le"), dtype="<u4"), np.array([2]))
        assert np.exp(logs).sum() + np.exp(unseen[0]) == pytest.approx(1.0)


def test_letters_beyond_sixteen_bits_are_counted(spark):
    text = "".join(chr(0x10000 + k) for k in range(70_000)) + " \U0001f600ab"
    got = {r.gram: r.c for r in char_lm.count_grams(spark.createDataFrame([(text, "x")], "text string, lang string")).collect()}
    assert len(got) == len(text) and got[" \U0001f600ab"] == 1


def _statistics(text):
    w = words(text)
    windows = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


@pytest.mark.parametrize("clashing", [False, True])
def test_quality_of_awkward_rows(spark, tmp_path, clashing):
    frame = written(spark, docs(spark, clashing=clashing), tmp_path)
    rows = quality.judge(frame).collect()
    key = lambda x: tuple(map(str, x))
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=key)
    assert got == sorted(((i, *_statistics(t)) for i, t, *_ in AWKWARD), key=key)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    left = quality.keep_good(frame)
    assert left.columns == frame.columns and left.count() == sum(r.kept for r in rows)


def test_large_models_are_joined_with_the_same_verdicts(spark, monkeypatch):
    frame = given(spark, "documents")
    small = {r.doc_id: (r.kept, r.log_perplexity) for r in quality.judge(frame).collect()}
    monkeypatch.setattr(char_lm, "ARRAY_ENTRIES", 0)
    large = {r.doc_id: (r.kept, r.log_perplexity) for r in quality.judge(frame).collect()}
    assert {i: k for i, (k, _) in small.items()} == {i: k for i, (k, _) in large.items()}
    assert [small[i][1] for i in small] == pytest.approx([large[i][1] for i in small])
    assert {r.doc_id for r in quality.keep_good(frame).collect()} == {i for i, (k, _) in large.items() if k}


def test_bands_are_median_and_deviation(spark):
    rng = np.random.default_rng(1)
    values = {"x": rng.normal(1.5, 0.1, 2_001), "y": np.array([2.0])}
    rows = [(lang, float(v), False) for lang, vs in values.items() for v in vs] + [("x", 99.0, True), ("x", None, False)]
    got = {r.lang: (r.low, r.high) for r in quality.bands(spark.createDataFrame(rows, "lang string, log_perplexity double, base_failed boolean")).collect()}
    for lang, vs in values.items():
        middle = np.median(vs)
        half = 6 * max(1.4826 * np.median(np.abs(vs - middle)), 0.01)
        assert got[lang] == pytest.approx((middle - half, middle + half), abs=0.01)


def test_good_documents_stay_and_junk_goes(spark):
    labels = {r.doc_id: r.quality for r in given(spark, "labels", "/root/testdata/sf0.01").collect()}
    rows = [r for r in quality.judge(given(spark, "documents", "/root/testdata/sf0.01")).collect() if not r.base_failed and r.doc_id in labels]
    kept = {q: [r.kept for r in rows if labels[r.doc_id] == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.8


def test_junk_is_rejected_and_clean_text_kept_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in given(spark, "labels", sf).collect()}
    rows = [r for r in quality.judge(given(spark, "documents", sf)).collect() if not r.base_failed and r.doc_id in labels]
    for lang in ("en", "de", "fr", "es"):
        kept = {q: [r.kept for r in rows if r.lang == lang and labels[r.doc_id] == q] for q in (0, 1)}
        assert len(kept[0]) > 30 and not any(kept[0]) and np.mean(kept[1]) > 0.98


def test_a_text_is_not_scored_by_its_own_counts(spark):
    """An odd text alone among others is no likelier for having been in the table; a lone text still has a model."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["river", "stone", "music", "garden", "winter", "letter", "window"], 80)), "en", "s", 0) for i in range(40)]
    odd = [(99, " ".join("zyqxj"[int(k)] * 2 + "wvkpf"[int(j)] for k, j in rng.integers(0, 5, (80, 2))), "en", "s", 0),
           (100, " ".join(f"word{k}" for k in range(80)), "xx", "s", 0)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows + odd)).collect()}
    letters = len(set("riverstonemusicgardenwinterletterwindow ") | set("zyqxjwvkpf"))
    assert not got[99].base_failed and not got[99].kept and got[99].log_perplexity > math.log(letters)
    assert got[100].kept and all(got[i].kept or got[i].base_failed for i in range(40))


def test_quality_of_an_empty_table(spark, tmp_path):
    frame = written(spark, docs(spark, []), tmp_path)
    assert quality.judge(frame).collect() == [] and quality.keep_good(frame).collect() == []


# -- 4 toxicity ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reader(spark):
    return toxicity.restorer(given(spark, "documents", "/root/testdata/sf0.01"))()


@pytest.mark.parametrize(("token", "word"), [
    ("1d10t", "idiot"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("$tupid", "stupid"), ("m0r0n", "moron"), ("l0$er", "loser"),
    ("tr@sh!!", "trash"), ("p4thet1c", "pathetic"), ("the.", "the"), ("THE!!", "the"), ("thing,", "thing"), ("|", ""), ("###", ""),
])
def test_disguises_are_undone(reader, token, word):
    assert reader.word(token) == word


def read_words(reader, texts):
    """(restored words, document of each)."""
    ids = {}
    which, doc = reader.words(texts, lambda tokens: [tuple(ids.setdefault(w, len(ids)) for w in reader.readings(t)) for t in tokens.to_pylist()],
                              lambda w: ids.setdefault(w, len(ids)))
    names = list(ids)
    return [names[w] for w in which], [int(d) for d in doc]


def test_spaced_letters_are_joined(reader):
    import pyarrow as pa

    found, doc = read_words(reader, pa.array(["you i d i o t there", "a b", "s t u p 1 d"], pa.large_string()))
    spaced = set(zip(doc, found))
    assert (0, "idiot") in spaced and (2, "stupid") in spaced and (1, "ab") not in spaced


@pytest.mark.parametrize(("text", "hidden"), [
    ("you are a i d i o t", {"idiot"}), ("s t u p i d i d i o t", {"stupid", "idiot"}), ("I h a t e", {"hate"}),
    ("stupid,idiot", {"stupid", "idiot"}), ("idiot/moron", {"idiot", "moron"}), ("1d10t-stup1d", {"idiot", "stupid"}),
])
def test_words_in_a_row_are_read_apart(reader, text, hidden):
    import pyarrow as pa

    found, doc = read_words(reader, pa.array([text], pa.large_string()))
    assert hidden <= set(found) and len(found) == len(doc)


@pytest.mark.parametrize(("text", "hidden"), [
    ("s t u p i d " * 400, "stupid"), (".".join("stupid" * 20), "stupid"), ("1d107", "idiot"),
])
def test_disguises_of_any_length_are_read(reader, text, hidden):
    import pyarrow as pa

    assert hidden in read_words(reader, pa.array([text], pa.large_string()))[0]


@pytest.mark.parametrize(("token", "hidden"), [
    ("iidiiot", "idiot"), ("stuupid", "stupid"), ("mooron.", "moron"), ("st*pid", "stupid"), ("id*ot!", "idiot"), ("\u0456d\u0456\u043et", "idiot"),
    ("\u2170d\u2170ot", "idiot"), ("\xefd\xeeot", "idiot"), ("\uff49\uff44\uff49\uff4f\uff54", "idiot"), ("\u0430\u0435", "ae"),
])
def test_doubled_masked_and_look_alike_letters_are_read(reader, token, hidden):
    assert hidden in reader.read(token)


@pytest.mark.parametrize("token", ["good", "committee", "don't", "stra\xdfe", "\u043f\u0440\u0438\u0432\u0435\u0442", "na\xefve"])
def test_words_as_written_stay_readings(reader, token):
    assert token.replace("'", "") in reader.read(token)


def test_features_are_found_as_the_readings_say(reader, spark):
    """The look-up of many tokens against the readings of each."""
    import pyarrow as pa

    texts = [r.text or "" for r in given(spark, "documents", "/root/testdata/sf0.01").select("text").collect()]
    tokens = sorted({w for t in texts for w in words(t)} | {"iidiiot", "STUPID!", "'idiot'", "(idiot)", "idiooot.", "st*pid", "ii", "", "\u0456diot", "idi\xf6t"})
    index = {w: i for i, w in enumerate(["stupid", "idiot", "moron", "good", "committee", "be", "i", "a", "stra\xdfe", "strase", "hello", "off"])}
    marker = toxicity.Marker(reader, index)
    for _ in range(2):
        got = marker.numbers(pa.array(tokens, pa.large_string()))
        assert [set(x) for x in got] == [{index[w] for w in reader.read(t) if w in index} for t in tokens]


def test_decoding_is_the_best_path(reader):
    """Viterbi against all readings of short tokens."""
    import itertools

    for token in ("1d1", "$t0", "aaab", "i.d"):
        best = -math.inf
        for ways in itertools.product(*reader.lattice(token)):
            word = "".join(w for w, _ in ways) + " "
            score, state = sum(c for _, c in ways), "  "
            for c in word:
                score += reader.step(state, c)
                state = (state + c)[-2:]
            best = max(best, score)
        assert reader.decode(token)[1] == pytest.approx(best)


def _toxic_rows():
    rng = np.random.default_rng(4)
    plain = ["river", "stone", "music", "garden", "winter", "letter", "window", "market"]
    rude = ["numskull", "dimwit", "rotter"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = list(rng.choice(plain, 30))
        if toxic:
            for _ in range(3):
                text.insert(int(rng.integers(30)), str(rng.choice(rude)))
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_is_learnt_from_rows_not_held_out_and_sees_disguises(spark):
    rows, labels = _toxic_rows()
    hidden = [(9_001, "river stone n u m s k u l l garden music", "en", "s", 0), (9_002, "winter d1mw1t letter r0tt3r", "en", "s", 0),
              (9_003, "window market river", "en", "s", 0)]
    frame = docs(spark, rows + hidden + [(9_004 + k, *r[1:]) for k, r in enumerate(AWKWARD)], clashing=True)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]  # wrong where held out
    table = spark.createDataFrame(flipped, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame, table).collect()}
    truth = {i: t for i, _, t in labels}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].predicted == truth[i] for i in truth)
    assert got[9_001].predicted == 1 and got[9_002].predicted == 1 and got[9_003].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[9_004 + k].predicted == 0 for k in range(len(AWKWARD)))


def test_held_out_accuracy_on_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in given(spark, "labels", sf).collect()}
    rows = [r for r in toxicity.toxicity(given(spark, "documents", sf), given(spark, "labels", sf)).collect() if r.held_out and r.doc_id in labels]
    hit = [r.predicted == labels[r.doc_id] for r in rows]
    caught = [r.predicted for r in rows if labels[r.doc_id] == 1]
    assert np.mean(hit) > 0.97 and np.mean(caught) > 0.8


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs(spark), none).collect()} == {0}
    assert toxicity.toxicity(docs(spark, []), none).collect() == []
