"""Search tokens, matching, entity graphs, regimes and marked spans on hand-made cases."""

import html
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from evigrain.functions import tokenizer
from evigrain.operators import entities, matching, relational, spans, structure


def plain_tokens(text, lang):
    text = unicodedata.normalize("NFKC", text or "").lower()
    for sign in "'’ʼ":
        text = text.replace(sign, " ")
    words = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Pc" else " " for c in text).split(" ")
    cjk = lambda c: any(a <= ord(c) <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF)))
    out = []
    for w in filter(None, words):
        run = "".join(filter(cjk, w))
        if not run or any("a" <= c <= "z" for c in w):
            out.append(w)
        if run:
            out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
    stop = tokenizer.SEARCH_STOPWORDS.get((lang or "").lower(), tokenizer.SEARCH_STOPWORDS["en"])
    return [w for w in out if w not in stop]


def test_search_tokens(spark):
    rng = random.Random(3)
    cases = [("The Controller shall process data", "en"), ("L’État doit protéger l'accès", "FR"), ("個人データの保護 act", "zh"), ("第26条", None), ("ＡＢＣ ﬁnance ｱｲ x中y", "en"), ("état snake_case 1.5", "fr"), (None, "en"), ("", None), ("der und die", "de"), ("der und die", "xx"), ("و هذا كتاب", "ar")]
    cases += [("".join(rng.choice("abÉßlL'’ʼ中文字カ한ﬀ½ _-.\n１é́") for _ in range(rng.randint(0, 25))), rng.choice(["en", "fr", "es", "de", "zh", "ar", None])) for _ in range(300)]
    rows = spark.createDataFrame(cases, "text string, lang string").select("text", "lang", tokenizer.search_tokens(F.col("text"), F.col("lang")).alias("t"), tokenizer.is_supported(F.col("lang")).alias("s")).collect()
    for r in rows:
        assert r.t == plain_tokens(r.text, r.lang), r.text
        assert r.s == ((r.lang or "").lower() in tokenizer.SEARCH_STOPWORDS)


def test_ranks_of_large_groups(spark):
    rng = random.Random(4)
    ids = rng.sample(range(-500, 5000), 900)
    df = spark.createDataFrame([(rng.choice(["a", "a", "a", "b", None]), i) for i in ids], "g string, i long")
    got = relational.ranked(df, ["g"], "i", "r", width=64).collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.i)
    assert {(r.g, r.i, r.r) for r in got} == {(g, i, k + 1) for g, found in groups.items() for k, i in enumerate(sorted(found))} and len(got) == 900


PROVISION = "id long, jurisdiction string, indicator string, doc string, band string, tier string, span string"


def test_gold_scores(spark):
    gold = spark.createDataFrame([(1, "FR", "6.1", "Law-1", "1", "A", "personal  data"), (2, "fr ", "6.1", "law1", "0", "B", "x"), (3, "FR", "6.2", "law2", "0.5", "A", "y"), (4, "DE", "6.1", None, "null", "A", None)], PROVISION)
    predicted = spark.createDataFrame([(10, "fr", "6.1", "LAW 1", "1", "A", "On Personal Data here", None), (11, "fr", "6.1", "law1", "1", "B", "z", "new"), (12, "fr", "6.1", "law1", "1", "B", "z", "NEW"), (13, "it", "6.9", "law9", "1", "B", "z", "KNOWN")], PROVISION + ", tag string")
    pairs = matching.same_provision(gold, predicted)
    assert {tuple(r) for r in pairs.collect()} == {(1, 10), (2, 11)}
    found = matching.outcomes(gold, predicted, pairs)
    assert sorted(r.kind for r in found.collect()) == ["matched", "matched", "missed", "missed", "new", "spurious"]
    got = matching.scores(found).first().asDict()
    assert got == {"field_accuracy": 0.5, "indicator_accuracy": 1.0, "band_accuracy": 0.5, "tier_accuracy": 1.0, "citation_fidelity": 0.5, "false_zero_rate": 0.5, "tp": 2, "fn": 2, "fp": 1, "discovery_new": 1, "gold_total": 4, "predicted_total": 4}
    labels = {r.label: (r.tp, r.fp, r.fn) for r in relational.precision_recall(matching.labelled(found), "truth", "predicted").collect()}
    assert labels["6.1"] == (2, 0, 1) and labels["6.2"] == (0, 0, 1) and labels["6.9"] == (0, 1, 0) and labels[matching.NO_CLAIM] == (0, 2, 1)
    none = gold.where("id < 0")
    assert matching.scores(matching.outcomes(none, predicted.where("id < 0"), matching.same_provision(none, none))).first().field_accuracy == 0.0


def test_best_claims(spark):
    gold = [(1, "fr", "a", "d1"), (2, "fr", "b", "d1"), (3, "fr", "b", "d9"), (4, "de", "a", "d2"), (5, "fr", "c", "d8"), (6, None, None, None)]
    claims = [(10, "fr", "b", "d1"), (11, "fr", "z", "d1"), (12, "fr", "b", "d7"), (13, "fr", "y", "d6"), (14, "it", "a", None)]
    schema = "id long, jurisdiction string, indicator string, doc string"
    got = {tuple(r) for r in matching.best_claims(spark.createDataFrame(gold, schema), spark.createDataFrame(claims, schema)).collect()}
    assert got == {(2, 10, 1), (1, 11, 2), (3, 12, 3), (5, 13, 4)}
    first = {tuple(r) for r in matching.first_claims(spark.createDataFrame(gold, schema), spark.createDataFrame(claims, schema)).collect()}
    assert first == {(1, 10), (2, 10)}


def test_best_claims_are_stable(spark):
    """No gold row and claim that aren't paired share a better tier than both their own pairs; none is used twice."""
    rng = random.Random(5)
    row = lambda i: (i, rng.choice("fd"), rng.choice("ab"), rng.choice("xyz"))
    gold, claims = [row(i) for i in range(40)], [row(i) for i in range(100, 130)]
    schema = "id long, jurisdiction string, indicator string, doc string"
    pairs = matching.best_claims(spark.createDataFrame(gold, schema), spark.createDataFrame(claims, schema)).collect()
    assert len({r.gold_id for r in pairs}) == len(pairs) == len({r.claim_id for r in pairs})
    tier = lambda g, c: 1 if g[2:] == c[2:] else 2 if g[3] == c[3] else 3 if g[1:3] == c[1:3] else 4 if g[1] == c[1] else 9
    of_gold, of_claim = {r.gold_id: r.tier for r in pairs}, {r.claim_id: r.tier for r in pairs}
    for g in gold:
        for c in claims:
            assert tier(g, c) >= min(of_gold.get(g[0], 9), of_claim.get(c[0], 9))


def test_similar_pairs_and_tags(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 30))] for _ in range(40)]
    rows = [(i, rng.choice("ab"), list(rng.choice(base))) for i in range(150)] + [(999, "a", [])]
    for _, _, words in rows:
        if words and rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"v{rng.randrange(99)}"
    df = spark.createDataFrame(rows, "doc_id long, cell string, tokens array<string>")
    sets = relational.token_sets(df, "doc_id", ["cell"], "tokens")
    got = {(r.left_id, r.right_id) for r in relational.similar_pairs(sets, ["cell"], 0.6).collect()}
    first = {}
    for i, c, w in sorted(rows):
        if w:
            first.setdefault((c, frozenset(w)), i)
    want = {(i, j) for (c, a), i in first.items() for (d, b), j in first.items() if c == d and i < j and len(a & b) / len(a | b) >= 0.6}
    assert got == want and len(want) > 5
    gold = spark.createDataFrame([(i,) for i in range(0, 150, 10)], "doc_id long")
    tags = {r.doc_id: r.tag for r in matching.discovery_tags(df, gold, ["cell"], 0.6).collect()}
    for i, c, w in rows:
        near = any(c == d and w and v and len(set(w) & set(v)) / len(set(w) | set(v)) >= 0.6 for j, d, v in rows if j % 10 == 0 and j < 150)
        assert tags[i] == ("KNOWN" if i % 10 == 0 and i < 150 or near else "NEW")


def test_entity_graph(spark):
    text = '"Personal Data" means x under Section 4(2) of 2024-02-03 or 3rd March 2021, USD 1,200.50 and €5'
    row = spark.createDataFrame([(text,)], "t string").select(entities.entities_in(F.col("t")).alias("e")).first()
    assert [(e.kind, e.key) for e in row.e] == [("defined_term", "personal data"), ("cross_ref", "section 4(2)"), ("date", "2024-02-03"), ("date", "3rd march 2021"), ("money", "usd 1,200.50"), ("money", "€5")]
    elements = spark.createDataFrame([(1, "p", None, "section 1 and section 2"), (1, "c", "p", "section 3"), (1, "d", "c", "section 1"), (2, "p", None, "section 9"), (2, "n", "p", None)], "doc_id long, element_id string, parent_id string, text string")
    found = entities.element_entities(elements)
    assert {tuple(r) for r in entities.cooccurrence(found, elements).collect()} == {(1, "section 1", "section 2"), (1, "section 1", "section 3"), (1, "section 2", "section 3")}
    assert {(r.doc_id, r.key, r.elements) for r in entities.node_index(found).collect()} == {(1, "section 1", 2), (1, "section 2", 1), (1, "section 3", 1), (2, "section 9", 1)}
    claims = spark.createDataFrame([("a", "Section  1, section 7"), ("b", "section 2"), ("c", "nothing"), ("d", "section 1"), ("e", None)], "claim_id string, text string")
    evidence = spark.createDataFrame([("a", 1, "p"), ("a", 1, "p"), ("b", 1, "p"), ("b", 9, "gone"), ("c", 1, "p"), ("d", 2, "x"), ("e", 1, "c")], "claim_id string, doc_id long, element_id string")
    got = {r.claim_id: (r.elements, r.entities, r.unresolved, r.passed, r.detail) for r in entities.graph_grounding(claims, evidence, elements).collect()}
    assert got == {"a": (1, 2, ["cross_ref:section 7"], False, "unresolved"), "b": (1, 1, [], True, "resolved"), "c": (1, 0, [], True, "no entity"), "d": (0, 1, [], False, "no element"), "e": (1, 0, [], True, "no entity")}


def test_regimes(spark):
    elements = spark.createDataFrame([(1, e, t) for e, t in zip("pabcdef", ["section", "definition", "paragraph", "paragraph", "paragraph", "definition", "paragraph"], strict=True)] + [(2, "a", "section")], "doc_id long, element_id string, element_type string")
    edges = spark.createDataFrame([(1, "p", "a", "defines"), (1, "a", "p", "cross_reference"), (1, "b", "p", "proviso"), (1, "b", "c", "notwithstanding"), (1, "c", "d", "defines"), (1, "p", "gone", "defines"), (2, "a", "p", "defines")], "doc_id long, from_element string, to_element string, edge_type string")
    claims = spark.createDataFrame([("x", 1, "p", "b", ["e", "a", "f", "none", "e"]), ("y", 1, "none", "c", []), ("z", 1, "none", "none", ["e"]), ("w", 2, "a", "a", None)], "claim_id string, doc_id long, primary_id string, clause_id string, hinted_ids array<string>")
    rows = lambda depth: {(r.claim_id, r.element_id, r.depth, r.place, r.role) for r in structure.regimes(claims, elements, edges, depth).collect()}
    assert rows(2) == {
        ("x", "p", 0, 0, "primary"), ("x", "a", 1, 1, "member"), ("x", "b", 1, 2, "exception"), ("x", "c", 2, 3, "exception"), ("x", "e", -1, 4, "definition"), ("x", "f", -1, 5, "member"),
        ("y", "c", 0, 0, "primary"), ("y", "d", 1, 1, "definition"), ("y", "b", 1, 2, "exception"), ("y", "p", 2, 3, "exception"), ("w", "a", 0, 0, "primary"),
    }
    assert {r[1] for r in rows(0) if r[0] == "x"} == {"p", "a", "e", "f"}
    with pytest.raises(ValueError):
        structure.regimes(claims, elements, edges, -1)


def test_marked_spans(spark):
    texts = spark.createDataFrame([(1, "a < b & \"c\" 'd' end"), (2, "plain & simple"), (3, None), (4, "")], "doc_id long, text string")
    rows = [(1, "s", 0, 5), (1, "t", 3, 9), (1, "u", 9, 12), (1, "v", 15, 99), (1, "w", -4, 0), (1, "x", 6, 6), (3, "y", 0, 2), (9, "z", 0, 2)]
    found = spark.createDataFrame(rows, "doc_id long, span_id string, char_start int, char_end int")
    kept = spans.clamped(found, texts)
    got = sorted((r.char_start, r.char_end, r.span_ids) for r in spans.segments(kept).collect())
    text = "a < b & \"c\" 'd' end"
    assert got == [(0, 3, ["s"]), (3, 5, ["s", "t"]), (5, 9, ["t"]), (9, 12, ["u"]), (15, len(text), ["v"])]
    marked = {r.doc_id: (r.html, r.marks) for r in spans.marked_texts(texts, found).collect()}
    e = html.escape
    assert marked[1] == (f"<mark>{e(text[:12])}</mark>{e(text[12:15])}<mark>{e(text[15:])}</mark>", 2)
    assert marked[2] == ("plain &amp; simple", 0) and marked[3] == (None, 0) and marked[4] == ("", 0)
