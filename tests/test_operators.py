"""Operators on literal rows."""

import os
import re
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from hopframe.functions import text as X
from hopframe.operators import corpus as C
from hopframe.operators import index as I
from hopframe.operators import loop as L
from hopframe.operators import metrics as M
from hopframe.operators import retrieve as R
from hopframe.operators import rewards as W


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("pred,gold,contain,exact,f1", [("London", "London, England", 1, 0, 2 / 3), ("the", "x", 1, 0, 0), ("", "x", 0, 0, 0), ("A Cat!", "cat", 1, 1, 1), ("dog", "cat", 0, 0, 0)])
def test_answer_metrics(spark, pred, gold, contain, exact, f1):
    assert one(spark, X.contain_match("p", "g"), p=pred, g=gold) == contain
    assert one(spark, X.exact_match("p", "g"), p=pred, g=gold) == exact
    assert one(spark, X.token_f1("p", "g"), p=pred, g=gold) == pytest.approx(f1)


def test_reward_f1(spark):
    assert one(spark, X.reward_f1("p", "g"), p="David", g="David Arquette") == pytest.approx(2 / 3)
    assert one(spark, X.best_reward_f1("p", F.array(F.lit("David Arquette"), F.lit("David"))), p="David") == 1
    assert one(spark, X.reward_f1("p", "g"), p="", g="") == 1


def test_text(spark):
    assert one(spark, X.normalize_text("t"), t="  Al\n  B\tC  D. ") == "Al B C D."
    assert one(spark, X.normalize_key("t"), t=" Straße  X") == "strasse x"
    assert one(spark, X.sentences("t"), t="One. Two! Three") == ["One.", "Two!", "Three"]
    assert one(spark, X.capitalized_phrases("t"), t="Is Marie Curie from Warsaw or The Hague?") == ["Marie Curie", "Warsaw", "Hague"]
    assert one(spark, X.occurrences("t", "p"), t="aXaXXa", p="X") == 3 and one(spark, X.occurrences("t", "p"), t="a", p="") == 0
    assert one(spark, X.has_unseen_term("q", "a"), q="who won in Canada", a="the canadian team") is False
    assert one(spark, X.has_unseen_term("q", "a"), q="who won in Peru", a="the canadian team") is True
    assert one(spark, X.fenced_json("t"), t='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, X.strict_bool("t"), t="No") is False
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, X.strict_bool("t"), t="maybe")


def test_sentences_keep_the_digits_of_their_place(spark):
    text = "0 is none. 1 is 1. 28.68.191.238 is 2! Is it 3? 44"
    assert one(spark, X.sentences("t"), t=text) == ["0 is none.", "1 is 1.", "28.68.191.238 is 2!", "Is it 3?", "44"]


def test_phrases_match_python(spark):
    text = "Anna-Marie met O'Neil. Is Bob Who Knows in New York City? ÉLAN Und A1 b2"
    want = [re.sub(r"^(?:(?:" + "|".join(X.STOP_STARTS) + r")(?:\s+|$))+", "", m).strip() for m in re.findall(X._PHRASE, text)]
    assert one(spark, X.capitalized_phrases("t"), t=text) == [w for w in want if w]


def test_long_runs_of_capitalised_words(spark):
    """In a JVM of its own, which the old pattern ended at 2,000 words."""
    code = """
from pyspark.sql import SparkSession
from hopframe.operators import index as I
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([(1, "The " * 20000 + "Ab " * 20000 + "Cd-1 e. So Be It")], "passage long, body string")
print("sizes", [(r["sent_id"], len(r["entity"])) for r in I.mentions(rows).orderBy("sent_id", "entity").collect()], I.entity_sentences(I.mentions(rows)).count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "sizes [(0, 60003), (1, 8)] 2" in done.stdout


def test_entity_edges(spark):
    """Both forms count as str.count does, in time that grows with a long passage, not with passage times entities."""
    names = ["".join("ABCDEFGHIJ"[int(d)].lower() for d in str(i)).capitalize() for i in range(1, 20001)]
    long = " x. ".join(names) + " x. Aba Ababa x. Abababa"
    rows = [(1, "Anna saw Ann. AnnAnn met Ann Bo. No ann"), (2, ""), (3, "none here"), (4, long)]
    passages = spark.createDataFrame(rows, "passage long, body string")
    own = {(r["passage"], r["entity"]): (r["n"], round(r["weight"], 9)) for r in I.passage_edges(passages).collect()}
    assert own == {(r["passage"], r["entity"]): (r["n"], round(r["weight"], 9)) for r in I.entity_edges(I.mentions(passages), passages).collect()}
    body = rows[0][1]
    assert {e: n for (p, e), (n, _) in own.items() if p == 1} == {e: body.count(e) for e in ("Anna", "Ann", "AnnAnn", "Ann Bo", "No")}
    some = (*names[::997], "Aba Ababa", "Abababa")
    assert {e: own[4, e][0] for e in some} == {e: long.count(e) for e in some}
    assert I.occurrence_counts("ABABABA ABA", ["ABA", "AB", "BA ", ""]) == [3, 4, 1, 0]
    assert {p for p, _ in own} == {1, 4} and len([k for k in own if k[0] == 4]) == len({*names, "Aba Ababa", "Abababa"})
    started = time.process_time()
    entities = [f"N{i}x" for i in range(40000)]
    assert I.occurrence_counts(" ".join(entities), entities) == [1] * 40000
    assert time.process_time() - started < 5


@pytest.mark.parametrize(
    "role,body,ok",
    [
        ("answer", '{"can_answer":"TRUE","answer":"a","rationale":"r"}', True), ("answer", '{"can_answer":1,"answer":"a","rationale":"r"}', False), ("answer", '{"can_answer":false,"answer":null,"rationale":"r"}', True), ("answer", '{"can_answer":true,"answer":null,"rationale":"r"}', False), ("answer", '{"can_answer":"yes","answer":"a","rationale":"r"}', False),
        ("update_evidence", '{"selected_passage_ids":[0,1],"rationale":"r"}', True), ("update_evidence", '{"selected_passage_ids":["0"],"rationale":"r"}', False), ("update_evidence", '{"selected_passage_ids":[true],"rationale":"r"}', False), ("update_evidence", '{"selected_passage_ids":null,"rationale":"r"}', False), ("update_evidence", "[1]", False),
        ("query_retriever", '{"sub_goal":"s","query":"q"}', True), ("query_retriever", '{"query":"q"}', False), ("query_retriever", '{"sub_goal":" ","query":"q"}', False), ("query_retriever", '{"sub_goal":"s","query":""}', True),
        ("update_evidence", '{"selected_passage_ids":[]}', True), ("update_evidence", '{"selected_passage_ids":[0],"rationale":null}', False), ("answer", '{"can_answer":true,"answer":"a"}', True), ("answer", '{"can_answer":false}', False), ("query_retriever", "{bad", False),
    ],
)
def test_parse_actions(spark, role, body, ok):
    tag = L.TAGS[role]
    rows = spark.createDataFrame([(role, f"x <{tag}>\n{body}\n</{tag}> y"), (role, body)], "role string, text string")
    got = L.parse_actions(rows).collect()
    assert (got[0]["error"] == "") is ok and got[1]["error"] == "missing tag"


def test_facts_and_lookup(spark):
    df = spark.sql("select named_struct('title', array('A','B','C'), 'sent_id', array(0, 2)) as f")
    assert [tuple(p) for p in C.fact_pairs(df, "f").first()["pairs"]] == [("A", 0), ("B", 2)]
    pairs = spark.sql("select array(array('A','1'), array(' ','0')) as f")
    assert [tuple(p) for p in C.fact_pairs(pairs, "f").first()["pairs"]] == [("A", 1)]
    context = spark.createDataFrame([(1, 0, "A", ["a0"]), (1, 1, "A", ["z0", "z1"])], "qid int, pos int, title string, sentences array<string>")
    facts = spark.createDataFrame([(1, 0, "A", 1), (1, 1, "A", 9), (1, 2, "B", 0)], "qid int, pos int, title string, sent_id int")
    assert {(r["pos"], r["text"]) for r in C.sentence_lookup(facts, context).collect()} == {(0, "z1"), (1, None), (2, None)}
    flat = spark.createDataFrame([(["t"], [1])], "`f.title` array<string>, `f.sent_id` array<int>")
    assert C.nested_or_flat(flat, "f").columns == ["f"]
    chain = spark.sql("select array(array('s','r','o'), array('x')) as e").select(C.evidence_chain(F.col("e")).alias("c")).first()["c"]
    assert [tuple(x) for x in chain] == [(1, "s r ?", "o")]


def test_pagerank_by_hand(spark):
    edges = I.both_ways(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double"))
    reset = spark.createDataFrame([(0, 1, 1.0), (0, 3, float("nan")), (0, 2, -1.0)], "q long, node long, weight double")
    got = {r["node"]: r["score"] for r in R.personalized_pagerank(reset, edges, iterations=25, every=8).collect()}
    assert got == pytest.approx({1: 7 / 12, 2: 1 / 3, 3: 1 / 12}, abs=1e-6)


def test_propagation_by_hand(spark):
    seeds = spark.createDataFrame([(0, "a", 1.0)], "q int, entity string, score double")
    links = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "a"), ("s2", "c"), ("s3", "b"), ("s3", "d")], "sentence string, entity string")
    sim = F.when(F.col("sentence") == "s1", 0.8).when(F.col("sentence") == "s2", 0.6).otherwise(0.5)
    got = {r["entity"]: (round(r["weight"], 6), r["tier"]) for r in R.propagate(seeds, links, lambda d: d.withColumn("sim", sim)).collect()}
    # hop 1 picks s1: a and b get .8; hop 2: a picks s2 (.8 * .6), b picks s3 (.8 * .5)
    assert got == {"a": (2.28, 0), "b": (1.2, 1), "c": (0.48, 2), "d": (0.4, 2)}
    sims = links.select("sentence").distinct().withColumn("q", F.lit(0)).withColumn("sim", sim)
    seq = {r["entity"]: (round(r["weight"], 6), r["tier"]) for r in R.propagate_sequential(seeds, links, sims).collect()}
    assert seq["b"] == (0.8, 2) and seq["a"][1] == 1 and "d" not in seq


def test_dense_top_k_in_parts(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(50)]
    items = spark.createDataFrame(rows, "item long, vector array<double>").repartition(4)
    queries = spark.createDataFrame(rows[:9], "q long, vector array<double>")
    whole = sorted(map(tuple, I.dense_top_k(queries, items, 3).collect()))
    assert whole == sorted(map(tuple, I.dense_top_k(queries, items, 3, most_queries=4).collect()))
    assert len(whole) == 27


def test_single_hop_total(spark):
    turns = spark.sql("select 1 as traj, 0 as round, 'who is it' as query, 'goal' as sub_goal, 3 as n_words, array(0) as retrieved, array(named_struct('known', true, 'fact', 0)) as selected, true as can_answer, 1.0D as f1, cast(null as string) as parse_error, 1 as required")
    assert W.total_reward(turns).first()["total"] == pytest.approx(4.0625)
    assert W.terminal_reward(turns).first()["terminal"] == pytest.approx(3.0)


def test_advantages_and_loss(spark):
    rows = spark.createDataFrame([(0, "r", 0, 1.0, 4.0), (0, "r", 0, 3.0, 2.0), (1, "r", 0, 5.0, 5.0)], "grp int, role string, round int, local double, terminal double")
    got = sorted(r["advantage"] for r in W.action_advantage(rows, default=0.75).collect())
    assert got == pytest.approx([-0.5, 0.0, 0.5])
    with pytest.raises(ValueError):
        W.action_advantage(rows, {"answer": 1.5})
    reward = spark.createDataFrame([(True, True, True, 1, 0)], "match boolean, supported boolean, well_formed boolean, turns int, errors int")
    assert W.reward_v0(reward).first()["reward"] == pytest.approx(3.95)


def test_candidate_choice(spark):
    def chosen(rates, errors, orders):
        rows = [(b, 0, o, float(t), 1.0, e, 1.0, 1.0) for b, t, e, o in zip((1, 2, 4), rates, errors, orders)]
        runs = spark.createDataFrame(rows, "batch_size int, ord int, qid long, tokens double, seconds double, failed boolean, loss double, reward double")
        return [r["batch_size"] for r in M.selection(M.candidates(runs)).where("chosen").collect()]

    assert chosen((100, 107, 110), (False,) * 3, (7, 7, 7)) == [2]
    assert chosen((100, 107, 110), (False, True, False), (7, 7, 7)) == [1]
    assert chosen((100, 107, 110), (False,) * 3, (7, 8, 7)) == []


def test_loop_ends(spark):
    samples = spark.createDataFrame([(1, "who", ["T"], 2, "A1"), (2, "", [], 9, "B")], "qid long, question string, titles array<string>, hop_count int, gold string")
    turns = L.run_loop(samples, lambda d: d.withColumn("observed", F.when(F.col("query") != "", F.array(F.lit("Evidence A1"))).otherwise(F.array().cast("array<string>")))).collect()
    first = sorted((r for r in turns if r["traj"] == 1), key=lambda r: r["round"])
    assert [r["query"] for r in first] == ["T who", "T who"] and first[-1]["answer"] == "A1" and first[-1]["evidence"] == ["Evidence A1"] * 2
    assert len([r for r in turns if r["traj"] == 2]) == 3 and all(r["evidence"] == [] for r in turns if r["traj"] == 2)


def test_stream_resumes(spark, tmp_path):
    from hopframe.streaming.incremental import run_stream

    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(10).withColumn("v", F.col("id") * 2).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    run_stream(spark, source, schema, sink, checkpoint, ["id"])
    spark.range(5, 15).withColumn("v", F.col("id") * 2).coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, schema, sink, checkpoint, ["id"])
    run_stream(spark, source, schema, sink, checkpoint, ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(15))


def test_record_pieces(spark):
    from hopframe.operators import records as Q

    ids = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, Q.left_padded(ids, 5, 0)) == [0, 0, 1, 2, 3] and one(spark, Q.left_padded(ids, 2, 0)) == [2, 3]
    assert one(spark, Q.right_padded(ids, 4, 9)) == [1, 2, 3, 9] and one(spark, Q.until_end(ids, 2)) == [1, 2] and one(spark, Q.until_end(ids, 8)) == [1, 2, 3]
    assert one(spark, Q.labels(ids, F.array(F.lit(7)))) == [-100, -100, -100, 7]
    assert one(spark, Q.log_softmax_at(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1))) == pytest.approx(-0.693147, abs=1e-5)
    assert one(spark, Q.pretty_json(F.lit('{"a":[1]}'))) == '{\n  "a": [\n    1\n  ]\n}'
    assert one(spark, Q.target("answer", F.struct(F.lit(True).alias("ok"), F.lit("x").alias("v")))) == '<answer>{"ok": true, "v": "x"}</answer>'
    assert one(spark, Q.answer_after_marker(F.lit("so. Answer: 42 "))) == "42" and one(spark, Q.prompt("Q: {q}", q=F.lit("why"))) == "Q: why"
    assert [tuple(r) for r in Q.progress(spark, 5, 2, 2).collect()][2:4] == [(2, 0, 5), (3, 1, 2)]
    rows = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    good = Q.call_model(rows, "p", "r", lambda: lambda ps: [p.upper() for p in ps]).collect()
    bad = Q.call_model(rows, "p", "r", lambda: lambda ps: ps[:1]).collect()
    assert [r["r"] for r in good] == ["A", "B"] and all("answers to" in r["error"] for r in bad)


def test_validation_rules(spark):
    row = "0 as round, 'who' as question, 'who in Peru' as query, array('a') as observed, {k} as top_k, array(1) as passage_ids, array(3) as ids, array() as before, array('a') as evidence, 'zzz' as answer, true as can_answer, 1 as retrieval_count, 0 as history, true as last"
    t = spark.sql("select 1 as traj, " + row.format(k=2)).withColumn("before", F.col("before").cast("array<string>"))
    got = L.validation_errors(t).select(F.explode("errors").alias("e")).select(X.filter_reason("e").alias("r")).collect()
    assert [r["r"] for r in got] == ["state_leakage", "unseen_intermediate_query", "top_k_mismatch", "invalid_passage_selection", "invalid_passage_selection", "missing_or_unsupported_final_answer"]


def test_hybrid_covers_every_passage(spark):
    """More than 2,000 passages: each has a prior and so a place in the ranking of a question with seeds."""
    n = 2050
    passages = spark.createDataFrame([(i, f"Near Zurich there is stone{i} number{i % 7}" if i == 3 else f"stone{i} number{i % 7} lies here") for i in range(n)], "passage long, body string")
    questions = spark.createDataFrame([(1, "Is Zurich near number5?"), (2, "which stone77 lies there")], "q long, question string")
    got = R.hybrid_retrieve(questions, passages, k=3000).collect()
    by = {h: {r["passage"]: r["score"] for r in got if r["how"] == h} for h in ("graph", "dense")}
    assert {(r["q"], r["how"]) for r in got} == {(1, "graph"), (2, "dense")} and len(by["dense"]) == n
    # only the passages of least dense score have no prior, as they are scaled to 0
    dense = {r["passage"]: r["score"] for r in R.hybrid_retrieve(spark.createDataFrame([(1, "is zurich near number5?")], "q long, question string"), passages, k=3000).collect()}
    least = min(dense.values())
    assert len(dense) == n and set(by["graph"]) == {p for p, x in dense.items() if x > least + 1e-12 or p == 3}


def test_hybrid_whole_graph_and_joins_agree(spark, monkeypatch):
    passages = spark.createDataFrame([(i, f"Near Zurich{i % 9} we saw Ab{chr(97 + i % 26)} with stone{i % 13}. So Ab{chr(97 + i % 7)} met Bern{i % 5} Road. ..." if i % 4 else f"stone{i} only") for i in range(80)] + [(900, ""), (901, "...")], "passage long, body string")
    questions = spark.createDataFrame([(1, "Is Zurich near Abc?"), (2, "which stone77 lies there"), (3, "Did Abd meet Bern Road?"), (4, "?")], "q long, question string")
    joined = {(r["q"], r["passage"]): (r["how"], round(r["score"], 9)) for r in R.hybrid_retrieve(questions, passages, 1000, most_edges=-1).collect()}
    monkeypatch.setattr(R, "personalized_pagerank", None)  # questions times nodes rows
    whole = R.hybrid_retrieve(questions, passages, 1000).collect()
    assert {(r["q"], r["passage"]): (r["how"], round(r["score"], 9)) for r in whole} == joined and {q for q, _ in joined} == {1, 2, 3}
    for q in (1, 2, 3):
        rows = sorted((r for r in whole if r["q"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows == sorted(rows, key=lambda r: (-r["score"], r["passage"]))


def test_hybrid_disk_follows_the_text(spark, monkeypatch):
    """A long sentence with many entities was written once for each of them, and each question's score of each passage."""
    from pathlib import Path

    from hopframe.operators import walk

    kept = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    used = lambda: sum(f.stat().st_size for f in kept.rglob("*") if f.is_file())
    names = [f"N{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    rows = [(i, " and ".join(f"{n} saw stone{(i * j) % 50}" for j, n in enumerate(names)) + ".") for i in range(20)]
    monkeypatch.setattr(walk, "forget", lambda *tables: None)
    before = used()
    got = R.hybrid_retrieve(spark.createDataFrame([(1, "Who saw Nab?")], "q long, question string"), spark.createDataFrame(rows, "passage long, body string")).collect()
    assert len(got) == 5 and used() - before < 4 * sum(len(b) for _, b in rows)


def test_hybrid_groups_and_parts_of_questions_agree(spark, monkeypatch):
    """Odd white space, equal passages and no text; a group for each question and parts of them, or one for all."""
    from hopframe.operators import walk

    rows = [(i, f"Near  Zurich{i % 9}\n we saw Ab{chr(97 + i % 26)} with stone{i % 13}.  So Ab{chr(97 + i % 7)} met Bern{i % 5} Road." if i % 4 else f"stone{i % 3} only") for i in range(60)]
    passages = spark.createDataFrame([*rows, *((i + 1000, b) for i, b in rows), (5000, None)], "passage long, body string")
    questions = spark.createDataFrame([(str(i), f"Is Zurich near Ab{chr(97 + i)}?" if i % 3 else f"which stone{i} lies there") for i in range(7)], "q string, question string")
    shape = lambda df: sorted((r["q"], r["rank"], r["passage"], r["how"], round(r["score"], 12)) for r in df.collect())
    whole = shape(R.hybrid_retrieve(questions, passages, 12))
    joined = shape(R.hybrid_retrieve(questions, passages, 1000, most_edges=-1))
    monkeypatch.setattr(walk, "STATE_BYTES", 1)
    monkeypatch.setattr(walk, "MOST_QUESTIONS", 3)
    assert shape(R.hybrid_retrieve(questions, passages, 12)) == whole and len(whole) == 7 * 12
    scores = {(q, p): (how, round(s, 9)) for q, _, p, how, s in joined}
    for (q, _, p, how, s), after in zip(whole, [*whole[1:], None]):
        assert scores[q, p] == (how, round(s, 9))
        assert after is None or after[0] != q or after[4] < s or after[2] > p


def test_blocks_that_come_early_wait(monkeypatch):
    from hopframe.operators import walk

    monkeypatch.setattr(walk, "_Block", lambda row: row["block"])
    got = list(walk._in_passes(iter([{"block": b} for b in "caabcbbca"]), 3, 3))
    assert [[b for n, b in got if n == i] for i in range(3)] == [["c", "a", "b"], ["a", "c", "b"], ["b", "c", "a"]]


def test_comparison_entities_of_whole_documents(spark, tmp_path):
    from hopframe.plans.registry import QUERIES

    names = [f"Na{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    long = "we met. " + " ".join(f"we saw {names[i * 7 % 300]} again. We saw {names[i * 7 % 300].upper()} too." for i in range(600))
    rows = [(1, "the old one. it was so. then Berlin came. at last Oslo and berlin, BERLIN."), (2, long), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["phrases"], r["entities"]) for r in QUERIES["capitalized_phrases"](spark, str(tmp_path)).collect()}
    assert got[1][1] == "Berlin|Oslo" and got[3][1] is None and got[4][1] == ""
    first = {}
    for p in got[2][0].split("|"):
        if len(p) >= 3:
            first.setdefault(p.lower(), p)
    assert got[2][1].split("|") == list(first.values()) and len(first) >= 300
