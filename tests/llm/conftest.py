from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``{id: text}`` or ``[(id, text), ...]``; ``extra`` adds columns by name."""

    def build(texts, lang=None, **extra):
        pairs = texts.items() if isinstance(texts, dict) else texts
        rows = [(i, text, lang(i) if callable(lang) else lang, "s", None if text is None else len(text),
                 *extra.values()) for i, text in pairs]
        return spark.createDataFrame(rows, SCHEMA + "".join(f", {name} string" for name in extra))

    return build


#: Rows that every operator has to take: nulls, blanks, ties, repeated rows, a null id.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "One"), (6, "ünïcode words here"), (None, "one two three"),
       (7, "a b c d e f g h"), (8, "a b c d e f g h"), (9, "12 34 !?")]


@pytest.fixture
def odd_docs(make_docs):
    """The odd rows, with columns whose names the operators use themselves."""
    clashing = ("bits", "component_id", "score", "lang_pred", "removed", "class", "item", "length", "kind", "digest", "gone_id")
    return make_docs(ODD, **{name: "x" for name in clashing})


@pytest.fixture
def no_docs(make_docs):
    return make_docs({})
