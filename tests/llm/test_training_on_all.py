"""How labels follow each other is trained on all documents, whatever their length and number."""

import numpy as np
import pytest

from arbora.llm import quality
from arbora.llm.quality import Model, Moves, trained

KNOWN = [("eng", w) for w in "the of and to in a is that it was for on as with by at from this are not".split()]


def book(i: int, lines: int) -> str:
    prose = f"It was the place that we came to in the year {i} and it is not far from the sea, as this man was told by the others."
    row = "a|1.5|2.5|x|77|88"
    return "\n".join([prose + f" w{i}x{j}" if j // 20 % 2 == 0 else f"{row}|{i * j}" for j in range(lines)])


@pytest.mark.parametrize("n", [3, 40])
def test_long_documents_train(spark, n):
    texts = [book(i, 400) for i in range(n)]
    assert min(map(len, texts)) > 20_000
    want = Moves.untrained()
    for _ in range(quality.ROUNDS):
        model = Model(KNOWN, want)
        want = Moves.of(sum(model.count([t]) for t in texts))
    got = trained(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(3), KNOWN)
    assert np.array_equal(got.start, want.start) and np.array_equal(got.step, want.step)
    assert not np.allclose(got.step, Moves.untrained().step, atol=0.01)


def test_no_document_trains_nothing(spark):
    got = trained(spark.createDataFrame([], "text string"), KNOWN)
    assert np.allclose(got.step, Moves.untrained().step)


def test_many_documents_all_count(spark):
    """More than any sample held: the counts of all are used."""
    df = spark.range(5000).selectExpr("concat('a|1|2|3 ', id, '\\n', 'b|1|2|3') text")
    model = Model(KNOWN)
    n = int(sum(model.count([r["text"] for r in df.collect()])[:7]))
    assert n == 5000


def test_what_states_show_can_be_trained(monkeypatch):
    """With a share for the trained chances they move towards the documents, alike at every size."""
    monkeypatch.setattr(quality, "STATED", 0.5)
    counts = sum(Model(KNOWN).count([book(i, 200)]) for i in range(5))
    small, large = Moves.of(counts), Moves.of(1000 * counts)
    table, delimiter = quality.HIDDEN.index("table"), 2
    assert small.shown[delimiter, table] > quality.DELIMITER[table] + 0.05
    assert np.allclose(small.shown, large.shown) and np.allclose(small.sizes.sum(1), 1)
    assert np.all((small.shown > 0) & (small.shown < 1))
    seg = np.zeros((3, quality.SEG), np.int32)
    assert np.isfinite(quality.evidence(seg, small)).all()


def test_any_number_of_languages(spark):
    """Seventy languages with words of their own, a thousand with the same words."""
    docs = spark.createDataFrame([(1, " ".join(f"the{i % 3}x w{i}q of{i % 2}x v{i}q and0x" for i in range(60)) + ".")], "doc_id bigint, text string")
    for n in (1, 70, 1000):
        common = [(f"l{i}", f"{w}x") for i in range(n) for w in ("the0", "the1", "the2", "of0", "of1", "and0")] + [("zz", "nothing")]
        r = quality.text_quality(docs, spark.createDataFrame(common, "lang string, word string")).first()
        assert abs(r["common_word_share"] - 0.6) < 1e-9
