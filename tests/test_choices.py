"""Choices and labels of any JSON: as Python's own json.loads and str have them."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import choices

SCHEMA = "id long, choices string, question_format string, correct_answer string"
BLANKS = " \t\n\r"


def loaded(text):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def texts_of(value, form):
    value = value or []
    if isinstance(value, dict):
        return [str(value.get(x, "")) for x in "ABCD" if value.get(x)]
    if form == "TF" and (not value or not isinstance(value, (list, str))):
        return ["True", "False"]
    return [str(x) for x in value[:4]] if isinstance(value, (list, str)) else []  # a truthy number or boolean: no list


def label_of(value, form, answer):
    answer = (answer or "").strip()
    if answer.upper() in {"A", "B", "C", "D"}:
        return answer.upper()
    if form == "TF" and answer.lower() in ("true", "false"):
        return "A" if answer.lower() == "true" else "B"
    value = value or []
    if isinstance(value, dict):
        return next((x for x in "ABCD" if str(value.get(x, "")).strip().lower() == answer.lower()), answer)
    if not isinstance(value, (list, str)):
        return answer
    return next(("ABCD"[i] for i, x in enumerate(value[:4]) if str(x).strip().lower() == answer.lower()), answer)


def check(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)
    args = F.col("choices"), F.col("question_format")
    for own, parsed in ((df, None), (choices.with_items(df), F.col("_parsed"))):
        out = own.select("id", choices.choice_texts(*args, parsed).alias("texts"), choices.answer_label(F.col("correct_answer"), *args, parsed).alias("label"))
        for r in out.collect():
            text, form, answer = rows[r.id]
            value = loaded(text)
            assert (r.texts, r.label) == (texts_of(value, form), label_of(value, form, answer)), rows[r.id]


PLAIN = [
    None, "[]", "{}", '""', "[ ]", "{ }", "null", "true", "0", "12", '"pqrst"', '"é😀x"', ' "ab" ', '["a","b"]', '\n["q","right"]', '\t{"A":"right"}', '{"A":"x","A":"right"}', '{"A":"x","B":"y","A":""}',
    '[1,-20,0,1.5]', "[0.0,-0.0,1.0,12.0001]", "[true,false,null]", '{"A":true,"B":0,"C":null,"D":"d"}', '{"b":"x","A":" Y ","Z":1}', '["true","null","1"]', '["a",]', '[,"a"]', '["a" "b"]', '{"A"}', '{"A":1,}', "[01]", "[1.]", "[+1]", "[12x]",
    '["x, y","[z]","{w}",": :"]', '{"A":"a:b,c","B":"[1]"}', '["' + "x" * 3000 + '"]', "[" + ",".join(["1"] * 900) + "]", '["A B"," C "]', "bad", "", "[1] x",
]
ODD = [
    "[1e-7,1E5,1e22,5e-324]", "[1E400,-1E400,NaN,Infinity]", "[-0,123456789012345678901234567890,0.1,100000000000000000000.0]", '["a\\u00e9\\n","\\"q\\""]', '[[1,"b",null,{"k":[true,"it\'s"]}],{"z":1,"a":2,"z":3}]',
    '{"A":[1,2],"B":{"x":"y"},"C":[],"D":{}}', '{"\\u0041":"esc"}', '"a\\tb"', '["\\ud800x"]', "[0.00001,0.12345678901234567,1.50,2.00]", "[" + ",".join(["1"] * 3000) + "]", "[" * 2000 + "]" * 2000, '["' + "y" * 9000 + '"]', '["a\tb"]', '["x"]\x00',
]
ANSWERS = ["right", " x ", "", None, "True", "none", "1e-07", "1.5", "b", "p"]


def test_fixed_cases(spark):
    rows = [(t, form, a) for t in PLAIN + ODD if t != '["\\ud800x"]' for form in ("MCQ", "TF") for a in ANSWERS]
    check(spark, rows)


def test_half_a_character(spark):
    df = spark.createDataFrame([(1, '["\\ud800x"]', "MCQ", "?x")], SCHEMA)
    assert choices.with_items(df).select("_parsed.shown").first()[0] == ["?x"]


def test_plain_choices_need_no_python(spark):
    df = spark.createDataFrame([(k, t, "MCQ", "x") for k, t in enumerate(PLAIN)], SCHEMA)
    plain = {r.choices for r in df.where(choices.is_plain(F.col("choices"))).collect()}
    sound = {t for t in PLAIN if t is None or (loaded(t) is not None or t == "null")}
    assert sound - plain == set() and plain - sound == set()
    explained = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in explained(choices.with_items(df.where(choices.is_plain(F.col("choices")))))
    assert "ArrowEvalPython" in explained(choices.with_items(df))


scalars = st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=6) | st.sampled_from(["A", " b ", "true", "x"])
values = st.recursive(scalars, lambda x: st.lists(x, max_size=5) | st.dictionaries(st.sampled_from(["A", "B", "C", "D", "a", "z"]), x, max_size=5), max_leaves=8)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(values, st.booleans(), st.sampled_from(["MCQ", "TF"]), st.sampled_from(ANSWERS), st.text(BLANKS, max_size=2)), min_size=20, max_size=60))
def test_any_json(spark, cases):
    rows = [(blank + json.dumps(v, ensure_ascii=e) + blank, form, a) for v, e, form, a, blank in cases]
    check(spark, [r for r in rows if "\\u" not in r[0] or "\\ud" not in r[0].lower()])


def test_choices_are_cut_once(spark):
    df = spark.createDataFrame([("[]",)], "choices string").select(choices.plain_items(F.col("choices")).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 2  # one for tokens, one for letters
