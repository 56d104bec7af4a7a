"""What the quality classifier learns from is bounded, whatever the length of texts."""

from lexiflow.llm import crf


def test_runs_of_lines():
    lines = [str(i).encode() for i in range(100)]
    assert crf._run(lines, 100, 7) == lines and crf._run(lines[:3], 5, 9) == lines[:3]
    for place in (0, 5, 90, 91, 12345):
        got = crf._run(lines, 10, place)
        assert len(got) == 10 and got == lines[int(got[0]) : int(got[0]) + 10]


def test_long_texts_are_learned_from(spark):
    good, bad = "A plain line of words, as one writes them.\n", "$$ ## {} || <<>> 1234 !!!!\n"
    data = [(i, (good if i % 2 else bad) * (3000 if i < 4 else 5)) for i in range(12)] + [(12, "\n" * 1_000_000), (13, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(12, 0)], "doc_id long, quality int")  # all of them are long
    model = crf.fit_quality(docs, labels, train_lines=64)
    score = {r.doc_id: r.score for r in crf.quality_scores(docs, model).collect()}
    assert all((score[i] > 0.5) == bool(i % 2) for i in range(12)) and len(score) == 14
