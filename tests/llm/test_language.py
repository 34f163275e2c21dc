"""Language mixtures: held-out accuracy, mixed texts, likelihood of the selected set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilar.llm import language


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs)


def test_counts_every_part_of_a_text(monkeypatch):
    text = "Ab  cd, éf\n12 ghi " * 40
    whole = language.ngram_counts(text)
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    assert whole.sum() == len(" ".join(words) + " ") + 2  # the text ends with a space; two more at its end
    for size in (1, 5, 64):
        monkeypatch.setattr(language, "BATCH_CHARS", size)
        assert (language.ngram_counts(text) == whole).all()


def test_held_out_accuracy(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = language.identify(docs, ~held).withColumn("held", held).collect()
    tested = [r["language"]["lang_pred"] == r["lang"] for r in rows if r["held"]]
    assert len(rows) == docs.count() and sum(tested) / len(tested) > 0.95
    assert all(0 <= r["language"]["score"] <= 1 for r in rows)


def test_mixed_texts_select_both_languages(docs, model):
    rows = docs.where("n_chars between 1000 and 4000").collect()
    en = [r["text"] for r in rows if r["lang"] == "en"][:10]
    de = [r["text"] for r in rows if r["lang"] == "de"][:10]
    assert en and de
    for a, b in zip(en, de):
        n = min(len(a), len(b))
        found = model.proportions([a[:n] + " " + b[:n]])[0]
        assert {"en", "de"} <= set(found) and abs(found["en"] - 0.5) < 0.2
        assert sum(found.values()) == pytest.approx(1)


def test_selection_by_brute_force(docs, model):
    """Penalised likelihood of each nested set by a plain loop over n-grams."""
    for r in docs.limit(12).collect():
        counts = language.ngram_counts(r["text"])
        used = np.flatnonzero(counts)
        n, p = counts[used].astype(float), model.likelihood[:, used]

        def fit(allowed):
            share = np.array([1 / len(allowed) if k in allowed else 0.0 for k in range(len(p))])
            for _ in range(language.ROUNDS if len(allowed) > 1 else 0):
                joint = share[:, None] * p
                share = (joint / joint.sum(axis=0) * n).sum(axis=1) / n.sum()
            return share, (n * np.log((share[:, None] * p).sum(axis=0))).sum()

        order = np.argsort(-fit(range(len(p)))[0], kind="stable")
        tries = [fit(order[:m].tolist()) for m in range(1, len(p) + 1)]
        values = [v - 0.5 * m * np.log(n.sum()) for m, (_, v) in enumerate(tries)]
        best = 0
        while best + 1 < len(values) and values[best + 1] > values[best]:
            best += 1
        want = {model.languages[k]: s for k, s in enumerate(tries[best][0]) if s > 0}
        assert model.proportions([r["text"]])[0] == pytest.approx(want)


def test_search_of_a_text_ends_by_itself(monkeypatch):
    """A likelihood that dips at two languages and rises at three, beside a text that gains at two."""
    values = {1: [0.0, 0.0], 2: [-1e3, 1e3], 3: [1e6, -1e6], 4: [0.0, 0.0]}

    def fit(given, weight, owner, starts, total, allowed, rounds=0):
        size = 4 if allowed.all() else int(allowed.sum(axis=0)[0])
        return allowed / allowed.sum(axis=0), np.array([values[size][int(n < 100)] for n in total])

    monkeypatch.setattr(language, "_fit", fit)
    model = language.LanguageModel(list("abcd"), np.full((4, 1 << language.BITS), 2.0 ** -language.BITS))
    dips, gains = "words of many " * 20, "a few words"
    together = model.proportions([dips, gains])
    assert together == model.proportions([dips]) + model.proportions([gains])
    assert [len(found) for found in together] == [1, 2]


def test_edges(spark, odd_docs, no_docs):
    rows = language.identify(odd_docs, F.lit(True)).collect()
    assert len(rows) == odd_docs.count() and rows[0]["key"] == "clash"
    for r in rows:
        unknown = not any(c.isalpha() for c in r["text"] or "")
        assert (r["language"]["lang_pred"] == "und") == unknown and (r["language"]["score"] == 0) == unknown
    assert language.identify(no_docs, F.lit(True)).count() == 0
    assert {r["language"]["lang_pred"] for r in language.identify(odd_docs, F.lit(False)).collect()} == {"und"}


def test_memory_of_many_short_texts(docs, model):
    """Ten thousand texts of forty characters at once take memory for their own n-grams only."""
    import tracemalloc

    texts = [r["text"][k:k + 40] for r in docs.where("n_chars > 2000").limit(10).collect() for k in range(1000)]
    one = [model.proportions([t])[0] for t in texts[:200]]
    tracemalloc.start()
    found = model.proportions(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 10_000 and peak < 300e6
    assert all(a == pytest.approx(b) for a, b in zip(found, one))
