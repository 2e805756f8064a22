"""Text features, classifiers, policies, feeds and sources."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from casewell import functions as fn
from casewell import schema as S
from casewell import sources as src
from casewell.operators import classify as cl
from casewell.operators import encode, feed, policy, stats
from casewell.sources.models import load_models, save_models

TEXTS = ["The card was blocked, the card is new", "Loan loan LOAN rate", "card rate x", None,
         "Ünïcode wörter wörter"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, complaint_text string")


def expected_tfidf(texts, stop, sublinear, size):
    """The weights in plain Python."""
    bags = []
    for t in texts:
        words = [w for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in stop]
        bags.append(Counter(words + [" ".join(p) for p in zip(words, words[1:])]))
    total, df = Counter(), Counter()
    for b in bags:
        total.update(b)
        df.update(b.keys())
    vocab = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab}
    out = {}
    for i, b in enumerate(bags):
        w = {t: (1 + math.log(n) if sublinear else n) * idf[t] for t, n in b.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, t): x / norm for t, x in w.items()})
    return out


@pytest.mark.parametrize("sublinear,stop,size", [(True, {"the", "was"}, 5000), (False, set(), 6)])
def test_tfidf(docs, sublinear, stop, size):
    got = {(r.id, r.term): r.weight for r in cl.tfidf_weights(
        docs, "complaint_text", "id", stop, 2, size, sublinear).collect()}
    want = expected_tfidf(TEXTS, stop, sublinear, size)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_feature_stages_equal_long_form(docs):
    rows = docs.where("complaint_text IS NOT NULL")
    model = cl.fit_features(rows, stop_words=["the"])
    counter = next(s for s in model.stages if hasattr(s, "vocabulary"))
    want = {(r.id, r.term): r.weight for r in cl.tfidf_weights(
        rows, "complaint_text", "id", ["the"]).collect()}
    for r in model.transform(rows).collect():
        got = {counter.vocabulary[i]: x for i, x in zip(r.features.indices, r.features.values)}
        assert got == pytest.approx({t: w for (i, t), w in want.items() if i == r.id})


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(i, f"card blocked atm {i}" if i % 2 else f"loan rate interest {i}",
             "Cards" if i % 2 else "Loans", "Angry" if i % 3 else "Neutral") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, complaint_text string, category string, "
                                     "sentiment string")
    return df, cl.train_models(df, ["category", "sentiment"], stop_words=[])


def test_predict_and_save(spark, trained, tmp_path):
    df, models = trained
    out = cl.predict(df, {**models, "severity": None})
    rows = out.collect()
    assert all(r.predicted_category == r.category for r in rows)
    assert all(0.5 < r.category_confidence <= 1 for r in rows)
    assert {(r.predicted_severity, r.severity_confidence) for r in rows} == {("Unknown", 0.0)}
    save_models(models, str(tmp_path / "m"))
    again = cl.predict(df, load_models(str(tmp_path / "m"), ["category", "sentiment"]))
    assert again.exceptAll(out.select(again.columns)).count() == 0
    # shared features once, or each model alone: the same labels
    alone = cl.predict(df, {"sentiment": models["sentiment"]}).select("id", "predicted_sentiment")
    assert alone.exceptAll(out.select("id", "predicted_sentiment")).count() == 0


def test_null_text_is_classified(spark, trained):
    _, models = trained
    df = spark.createDataFrame([(1, None)], "id long, complaint_text string")
    assert cl.classify_register(df, models).first().predicted_category in {"Cards", "Loans"}


def test_class_weights_and_labels(trained):
    df, _ = trained
    w = {r.label: r.weight for r in cl.class_weights(df, "sentiment").collect()}
    assert w == pytest.approx({"Angry": 40 / (2 * 26), "Neutral": 40 / (2 * 14)})
    assert {tuple(r) for r in cl.label_index(df, "category").collect()} == {("Cards", 0),
                                                                             ("Loans", 1)}


def test_split_is_repeatable_and_stratified(trained):
    df, _ = trained
    a = cl.stratified_split(df, "sentiment", "id")
    sizes = {(r.sentiment, r.is_test): r["count"] for r in
             a.groupBy("sentiment", "is_test").count().collect()}
    assert sizes[("Angry", True)] == 5 and sizes[("Neutral", True)] == 3
    b = cl.stratified_split(df.orderBy(F.desc("id")), "sentiment", "id")
    assert a.where("is_test").select("id").exceptAll(b.where("is_test").select("id")).count() == 0


def test_report_without_predictions_for_a_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "y string, p string")
    rep = {r["class"]: r for r in cl.classification_report(df, "y", "p").collect()}
    assert (rep["b"].precision, rep["b"].recall, rep["b"].f1, rep["b"].support) == (0, 0, 0, 1)
    assert rep["a"].precision == pytest.approx(2 / 3) and rep["a"].recall == 1
    assert rep["macro avg"].recall == 0.5
    assert rep["weighted avg"].recall == pytest.approx(2 / 3)


def test_encoders(docs):
    model = encode.fit_encoder(docs, dim=32)
    rows = {r.id: r.embedding for r in encode.encode_text(docs, model).collect()}
    assert len(rows) == 5 and all(len(v) == 32 for v in rows.values())
    assert np.linalg.norm(rows[0]) == pytest.approx(1, abs=1e-5)
    assert np.linalg.norm(rows[3]) == 0
    own = encode.encode_text(docs, lambda ts: np.array([[len(t), 1.0] for t in ts]), batch=2)
    assert {r.id: r.embedding[0] for r in own.collect()}[3] == 0


def test_chunker(spark, tmp_path):
    text = ("short\n\nA paragraph that is long enough.\n\n  \n\n"
            "Another sufficiently long paragraph.")
    (tmp_path / "x.txt").write_text(text)
    (tmp_path / "skip.pdf").write_text("no")
    chunks = policy.chunk_corpus(src.read_corpus(spark, str(tmp_path)))
    assert [(r.source, r.chunk_id) for r in chunks.orderBy("chunk_id").collect()] == [
        ("x.txt", "x.txt_0"), ("x.txt", "x.txt_1")]
    src.write_chunks(chunks, str(tmp_path / "out"))
    assert src.read_chunks(spark, str(tmp_path / "out")).count() == 2


def test_parse_answers(spark):
    fenced = '```json\n[{"complaint_text":" x ","resolution_note":"y"},{"complaint_text":""}]\n```'
    df = spark.createDataFrame([(1, fenced), (2, "nothing"), (3, None)], "id long, raw string")
    assert [tuple(r) for r in policy.parse_llm_output(df).collect()] == [(1, "x", "y")]
    drafts = spark.createDataFrame(
        [(1, '{"draft_response":"hi","action_items":["a"],"priority_score":7}'), (2, "broken"),
         (3, None), (4, '{"draft_response": ')], "id long, raw string")
    got = {r.id: r for r in policy.parse_draft(drafts).collect()}
    assert got[1].parsed and (got[1].draft_response, got[1].priority_score) == ("hi", 7)
    for i in (2, 3, 4):
        assert not got[i].parsed and got[i].root_cause == "Unable to analyze."
        assert got[i].action_items[0] == "Register complaint"
    verdict = spark.createDataFrame([("c", '{"can_auto_resolve": true, "reasoning": "ok"}')],
                                    "complaint_id string, raw string")
    assert policy.parse_verdict(verdict).first().can_auto_resolve
    trend = spark.createDataFrame([(1, "x")], "id long, raw string")
    assert policy.parse_trend(trend).first().top_concerns == []


def test_draft_without_policy(spark):
    rows = spark.createDataFrame(
        [(1, "please help", "Ann", "Credit Card", "Neutral", "Low"),
         (2, "this is FRAUD", None, "Odd", "Angry", "Low")],
        "query_id long, complaint_text string, customer_name string, predicted_category string, "
        "predicted_sentiment string, predicted_severity string")
    none = spark.createDataFrame([], "query_id long, policy_source string, policy_text string")
    got = {r.query_id: r for r in policy.draft_response(rows, none).collect()}
    assert got[1].draft_response == (
        "Dear Ann,\nWe have received your complaint regarding Credit Card. "
        "Our team is investigating this matter.")
    assert got[1].action_items == ["Log complaint details in the CRM",
                                   "Assign to Credit Card Disputes Team"]
    assert (got[1].priority_score, got[1].resolution_sla, got[1].regulatory_flag) == (
        3, "168 hours", False)
    assert got[1].customer_tone_tip == "Maintain a clear and professional tone."
    assert got[2].regulatory_flag and got[2].escalate_to == "Customer Service Team"
    assert got[2].customer_tone_tip == "Be professional."


def test_draft_joins_shared_texts_last(spark):
    """Texts by key give the drafts of a text column, and are shuffled for no other join."""
    rows = spark.createDataFrame(
        [(i, None if i == 5 else i % 2, "Credit Card", "Neutral", "Low") for i in range(6)],
        "query_id long, text_key long, predicted_category string, predicted_sentiment string, "
        "predicted_severity string")
    texts = spark.createDataFrame([(0, "please help"), (1, "this is FRAUD")],
                                  "text_key long, complaint_text string")
    best = spark.createDataFrame([(1, "P", "rule")],
                                 "query_id long, policy_source string, policy_text string")
    near = spark.createDataFrame(
        [(2, 7, "c", "x", "Low", 0.99, 1), (3, 8, "d", "x", "Low", 0.5, 1)],
        "query_id long, neighbour_id long, complaint_id string, category string, severity string, "
        "similarity double, rank int")
    shown = ["query_id", "complaint_text", "draft_response", "regulatory_flag", "duplicate_found"]
    late = policy.draft_response(rows, best, near, texts=texts).select(shown)
    early = policy.draft_response(rows.join(texts, "text_key", "left"), best, near).select(shown)
    assert sorted(map(str, late.collect())) == sorted(map(str, early.collect()))
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[1].startswith("+- Join") and "text_key" in plan.splitlines()[1]


def test_keywords_are_looked_for_once_in_each_text(spark):
    """Not in a text for each row that has it; in the text, the passage, in none, or without them."""
    rows = spark.createDataFrame(
        [(i, (i % 3) if i else None, "Credit Card", "Neutral", "Low") for i in range(8)],
        "query_id long, text_key long, predicted_category string, predicted_sentiment string, "
        "predicted_severity string")
    texts = spark.createDataFrame([(0, "help"), (1, "a FRAUD"), (2, None)],
                                  "text_key long, complaint_text string")
    best = spark.createDataFrame([(3, "P", "no rule"), (5, "Q", "Penalty"), (4, "R", None)],
                                 "query_id long, policy_source string, policy_text string")
    late = policy.draft_response(rows, best, texts=texts)
    early = policy.draft_response(rows.join(texts, "text_key", "left"), best)
    shown = ["query_id", "regulatory_flag", "regulatory_reason"]
    assert sorted(late.select(shown).collect()) == sorted(early.select(shown).collect())
    assert {r.query_id for r in late.where("regulatory_flag").collect()} == {1, 4, 5, 7}
    assert sorted(late.columns) == sorted(early.columns)
    plan = late.select(shown)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    assert not any("Contains" in line for line in plan[:joins[0]])


def test_product_mapping(spark):
    cases = {"Credit reporting": "Credit Card", "Debt collection": "Loan Services",
             "Mortgage": "Loan Services", "Checking or savings account": "Account Opening",
             "Money transfer": "Fund Transfer / NEFT / RTGS", "": "Customer Service",
             None: "Customer Service", "Credit card loan": "Credit Card"}
    df = spark.createDataFrame([(k,) for k in cases], "product string")
    assert {r.product: r.c for r in df.select("product", feed.map_product("product").alias("c"))
            .collect()} == cases


def test_feed_counts_add_up(spark, sf001):
    reg, ext = src.register(spark, sf001), src.external_feed(spark, sf001)
    assert feed.append_feed(reg, ext).count() == reg.count() + ext.count()


def test_scalar_helpers(spark):
    r = spark.range(1).select(
        fn.remaining_label(F.lit(0.5)).alias("a"), fn.remaining_label(F.lit(1.5)).alias("b"),
        fn.percent_text(F.lit(0.874)).alias("c"), fn.padded_id(F.lit(7)).alias("d"),
        fn.ellipsis(F.lit("abc"), 120).alias("e"),
        fn.ellipsis_if_longer(F.lit("abc")).alias("f"),
        fn.band(F.lit(0.95), fn.MATCH_BANDS).alias("g"),
        fn.band(F.lit(0.8), fn.BRANCH_BANDS, strict=True).alias("h"),
        fn.band(F.lit(8), fn.PRIORITY_BANDS).alias("i"), fn.urgency(F.lit(1.9)).alias("j"),
        fn.short_timestamp(F.lit("2024-01-02T03:04:05")).alias("k"),
        fn.prefix_key(F.lit("  ABC ")).alias("l"), fn.clamp_percent(F.lit(-3.0)).alias("m"),
        fn.parse_created(F.lit("2024-13-99")).alias("n"),
    ).first()
    assert tuple(r) == ("30m left", "2h left", "87%", "CMP0007", "abc...", "abc",
                        "Critical Match", "warning", "destructive", "destructive",
                        "2024-01-02 03:04", "abc", 0.0, None)


def test_csv_from_other_tools(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(
        ",".join(S.REGISTER_SCHEMA.names) + "\n"
        'CMP1000,"two\nlines, ""quoted""",Credit Card,Angry,Low,Email,b,Resolved,,2024-03-01,3,'
        "True,CMP1,a,b,c,x\n"
        "CMP1001,,Credit Card,Angry,Low,Email,b,Open,,2024-03-02,,False,,a,b,c,x\n")
    rows = src.read_register(spark, str(p)).orderBy("complaint_id").collect()
    assert rows[0].complaint_text == 'two\nlines, "quoted"'
    assert rows[0].is_duplicate is True and rows[0].resolution_days == 3.0
    assert rows[1].complaint_text is None and rows[1].resolution_days is None
    assert rows[1].created_date.isoformat() == "2024-03-02T00:00:00"


def test_report_files(spark, sf001, tmp_path):
    reg = src.register(spark, sf001)
    esc = spark.createDataFrame([], "complaint_id string, escalation_level string")
    rows = stats.regulatory_export(reg, "2024-01-30 12:00:00", esc)
    src.export_regulatory(rows, str(tmp_path / "rep"), "2024-01-30 12:00:00")
    back = spark.read.json(str(tmp_path / "rep"))
    assert back.count() == rows.count()
    assert back.select("export_date").distinct().first()[0] == "2024-01-30"
    src.write_pairs(spark.range(3), str(tmp_path / "pairs"), "csv")
    src.write_drafts(spark.range(3), str(tmp_path / "drafts"))
    assert spark.read.json(str(tmp_path / "drafts")).count() == 3


def test_terms_are_counted_in_their_task(spark):
    """Documents and occurrences of repeated terms, null texts and keys; no row an occurrence."""
    rows = spark.createDataFrame(
        [(1, "aa bb aa"), (2, "aa"), (3, None), (None, "bb bb"), (2, "aa cc"), (4, "")],
        "id long, text string")
    stats = cl.term_stats(rows, "text", max_n=1)
    assert {r.term: (r["count"], r.df) for r in stats.collect()} == {
        "aa": (4, 3), "bb": (3, 2), "cc": (1, 1)}
    found = cl.counted_terms(rows.coalesce(1), "text", "id", max_n=1).collect()
    assert sorted(map(str, found)) == sorted(map(str, [
        Row(id=1, term="aa", tf=2), Row(id=1, term="bb", tf=1), Row(id=2, term="aa", tf=1),
        Row(id=None, term="bb", tf=2), Row(id=2, term="aa", tf=1), Row(id=2, term="cc", tf=1)]))
    for df in (stats, cl.tfidf_weights(rows, "text", "id")):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
