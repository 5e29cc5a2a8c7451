"""Licence statements inside longer texts."""

import random

from ledgerlink.llm import licenses

random.seed(5)
OTHER = ["".join(random.choices("bcdfgklmnprst", k=6)) for _ in range(400)]
prose = lambda n: " ".join(random.choices(OTHER, k=n))


def wrapped(text, n=9):
    w = text.split(" ")
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_wrapped_notices_and_statements_in_paragraphs(spark):
    rows, want = [], set()
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        before = prose(50 + i)
        rows += [(2 * i, f"{before}\n{wrapped(text)}\n{prose(900)}"), (2 * i + 1, f"{before} {text} {prose(900)}")]
        want |= {(2 * i, name), (2 * i + 1, name)}
    rows.append((100, "\n".join([prose(300), wrapped(licenses.TEMPLATES["isc"]), prose(300), wrapped(licenses.TEMPLATES["isc"]), prose(300)])))
    rows.append((101, prose(40) + " " + licenses.TEMPLATES["mit-line"] + " " + prose(40) + "\n" + licenses.TEMPLATES["mit-line"]))
    rows.append((102, prose(3000)))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want <= {(r["doc_id"], r["template"]) for r in found}
    assert [r["template"] for r in found if r["doc_id"] == 100] == ["isc", "isc"]
    assert sorted(r["unit"] for r in found if r["doc_id"] == 101) == [-41, 2]
    assert not [r for r in found if r["doc_id"] == 102]
    for r in found:
        if r["unit"] < 0:
            w, at = licenses.normal_words(dict(rows)[r["doc_id"]]), -r["unit"] - 1
            b = set(licenses.template_bigrams(licenses.TEMPLATES[r["template"]]))
            assert any(len(x) == r["unit_bigrams"] and len(x & b) == r["shared"] for x in ({f"{p} {q}" for p, q in zip(w[at:e], w[at + 1 : e])} for e in range(at + 2, len(w) + 1)))
            assert r["dice"] >= 0.8
