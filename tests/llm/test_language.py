import numpy as np
import pyarrow as pa

from grantlens.llm import language, queries
from grantlens.llm.language import ORDER, LanguageModel, identify, letter_sequence, train
from grantlens.llm.words import blocks

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and the hens that think other things ",
    "de": "der schnelle braune fuchs springt über den faulen hund und die hühner der nachbarn ",
}


def counted(texts):
    rows = {}
    for lang, text in texts:
        for block in blocks(pa.array([text])):
            signs, _, _ = letter_sequence(block)
            for i in range(len(signs) - ORDER + 1):
                key = (lang, *signs[i : i + ORDER].tolist())
                rows[key] = rows.get(key, 0) + 1
    return rows


def fitted(texts):
    rows = counted(texts)
    langs = sorted({k[0] for k in rows})
    keys = sorted(rows)
    return LanguageModel.fit(
        langs,
        np.array([langs.index(k[0]) for k in keys]),
        np.array([k[1:] for k in keys]),
        np.array([rows[k] for k in keys]),
    )


def kneser_ney(texts, lang, gram):
    """The recursive definition, for one n-gram of the highest order."""
    rows = {k[1:]: n for k, n in counted(texts).items() if k[0] == lang}
    signs = len({k[-1] for k in counted(texts)}) + 1
    level = {ORDER: rows}
    for n in range(ORDER - 1, 0, -1):
        level[n] = {}
        for g in level[n + 1]:
            level[n][g[1:]] = level[n].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return 1 / signs
        own = level[len(g)]
        total = sum(c for k, c in own.items() if k[:-1] == g[:-1])
        if not total:
            return p(g[1:])
        kinds = sum(k[:-1] == g[:-1] for k in own)
        return max(own.get(g, 0) - 0.75, 0) / total + 0.75 * kinds / total * p(g[1:])

    return p(tuple(gram))


def test_probabilities_are_those_of_the_definition():
    texts = [(k, t * 2) for k, t in TEXTS.items()]
    model = fitted(texts)
    for gram in ("the ", " the", "xthe", "zqzq", "über", "ßßßß", "  th"):
        signs = [0 if c == " " else ord(c) for c in gram]
        got = model.log_probabilities([np.array([s]) for s in signs])[0]
        want = [np.log(kneser_ney(texts, k, signs)) for k in model.languages]
        assert np.allclose(got, want, atol=1e-5), gram


def test_probabilities_add_up():
    model = fitted([(k, t * 2) for k, t in TEXTS.items()])
    signs = sorted({0, *map(ord, "".join(TEXTS.values()).replace(" ", ""))})
    for context in ("the", "xyz", " fu"):
        before = [np.full(len(signs), 0 if c == " " else ord(c)) for c in context]
        total = np.exp(model.log_probabilities([*before, np.array(signs)])).sum(axis=0)
        assert ((total > 0.9) & (total <= 1.0001)).all()


def test_letters_only():
    (block,) = blocks(pa.array(["  A-b..C 1é ", "", "123"]))
    signs, text, letters = letter_sequence(block)
    assert letters.tolist() == [4, 0, 0]
    want = [0] * (ORDER - 1) + [ord("a"), 0, ord("b"), 0, ord("c"), 0, ord("é")]
    assert signs[text == 0].tolist()[: len(want)] == want


def test_held_out_accuracy(spark, sf_dir, given):
    truth = {r["doc_id"]: r["lang"] for r in given[1]}
    rows = queries.op3_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 20
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_rejection(documents, given):
    frame, _ = given
    model = train(frame)
    strange = documents(["qxzkj vwpqx zzkqj xqvbn " * 20, "日本語の文章です" * 20, "12345 67890", None, ""])
    rows = identify(strange.coalesce(1), model).collect()
    assert all(r["rejected"] for r in rows)
    assert [r["lang_pred"] for r in rows[2:]] == ["und"] * 3
    assert identify(frame, model).where("rejected").count() <= 2


def test_odd_rows(odd, given, spark):
    model = train(given[0])
    rows = identify(odd.withColumn("score", odd.lang).withColumn("_v", odd.lang), model)
    assert rows.count() == odd.count()
    got = {r["doc_id"]: r["lang_pred"] for r in rows.collect()}
    assert [got[i] for i in (1, 2, 3, None)] == ["und"] * 4 or got[1] == got[2] == got[3] == "und"
    assert identify(odd.limit(0), model).count() == 0
    assert train(odd.limit(0)) is None
    nothing = identify(odd, None).collect()
    assert all(r["lang_pred"] == language.UNKNOWN and r["rejected"] for r in nothing)


def test_order_of_rows_does_not_matter(given):
    frame, _ = given
    a, b = train(frame), train(frame.repartition(7))
    assert a.languages == b.languages
    assert all(np.array_equal(a.keys[n], b.keys[n]) and np.allclose(a.logp[n], b.logp[n]) for n in a.logp)
