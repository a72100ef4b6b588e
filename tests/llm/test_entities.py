"""Names keep one surrogate whatever introduces them, and what must not stay in a text is found."""

import pytest

pytest.importorskip("stagewise.llm")

from stagewise.llm import pii  # noqa: E402


def texts(spark, *values, key="k"):
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return [r.text for r in pii.replaced(docs, key).orderBy("doc_id").collect()]


def test_a_first_name_has_one_gender_in_all_documents(spark):
    new = texts(spark, "Mrs Ilka Walker wrote.", "Dr Ilka Walker wrote.", "No one here.", None, "", "Professor Ilka Walker and Mr Tarek Jones", "MRS WALKER; Prof. Tarek Stone")
    names = {t.split(" ")[1] for t in (new[0], new[1], new[5])}
    assert len(names) == 1 and names.pop()[-1] == "a" and "Ilka" not in "".join(t or "" for t in new)
    assert {t.split(" ")[2] for t in (new[0], new[1], new[5])} == {new[6].split(" ")[1].rstrip(";").capitalize()}
    assert new[5].split(" ")[5] == new[6].split(" ")[3] and new[2:5] == ["No one here.", None, ""]


def test_first_names_and_surnames_share_no_replacement(spark):
    rows = [(f"given:{g}:latin", f"name{i}") for i in range(1500) for g in "fmu"[i % 3]] + [("surname:u:latin", f"name{i}") for i in range(1500)]
    done = pii.assignments(spark.createDataFrame(rows, "kind string, canonical string"), "k").collect()
    assert len(done) == 3000 == len({r.surrogate for r in done}) and max(r.draw for r in done) > 0


def test_what_used_to_stay(spark):
    new = texts(spark, "MRS SMITH came", "Emma Walker wrote it", "password: hun$ter2!!", "from 2001:db8:85a3::8a2e:370:7334.", "at FE80:0:0:0:1:2:3:4 and fe80:0:0:0:1:2:3:4",
                "std::vector, add::face, 12:30:45 and 10::30", "token=abc123&user=x")
    assert "SMITH" not in new[0] and new[0].startswith("MRS ") and new[0].split(" ")[1].isupper()
    assert "Emma" not in new[1] and "Walker" not in new[1]
    assert "hun" not in new[2] and "ter2" not in new[2] and new[2].startswith("password: ")
    assert new[3].startswith("from 2001:") and new[3].endswith(".") and "85a3" not in new[3] and "7334" not in new[3]
    a, b = new[4][3:].split(" and ")
    assert a == b and a.startswith("fe80:") and a != "fe80:0:0:0:1:2:3:4"
    assert new[5].startswith("std::vector, add::face, 12:30:45 and ") and new[6].endswith("&user=x") and "abc123" not in new[6]
