"""Turtle files and phrases against plain Python."""

from collections import Counter

from rankloom.operators import keyphrases
from rankloom.sources import turtle

SKOS = turtle.SKOS
TEXT = '''@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
@prefix x: <http://example.org/x/> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
# a comment with a dot.
x:top a skos:Concept ; # the root
  skos:prefLabel "Top"@en , "Spitze"@de ; skos:note """several ; lines, here""" .
<http://example.org/x/a> skos:broader x:top ; skos:altLabel "A \\"quoted\\"; thing, x:b" .
x:b skos:broader x:top , x:a ; rdfs:label "B"@fr .
x:c skos:broader x:b , x:c ; skos:prefLabel """  C
 c """@en-GB ; x:size 7 , true , "1"^^x:int .
x:p skos:broader x:q ; skos:prefLabel "P" .
x:q skos:broader x:p ; skos:prefLabel "Q" .
x:n a skos:Concept ; skos:broader x:nowhere .
x:m x:has [ x:b x:c ] .
x:l x:list ( x:a x:b ) .
'''


def test_triples_and_paths(spark, tmp_path):
    (tmp_path / "one.ttl").write_text(TEXT)
    (tmp_path / "two.ttl").write_text('@prefix x: <http://example.org/x/> .\nx:d <http://www.w3.org/2004/02/skos/core#broader> x:b .\nx:d <http://www.w3.org/2000/01/rdf-schema#label> "D" .\n')
    got = turtle.triples(spark, str(tmp_path))
    x = "http://example.org/x/"
    rows = Counter(tuple(r) for r in got.collect())
    assert max(rows.values()) == 1
    for want in (
        (f"{x}top", f"{turtle.RDF}type", f"{SKOS}Concept", None), (f"{x}top", f"{SKOS}prefLabel", "Spitze", "de"), (f"{x}top", f"{SKOS}note", "several ; lines, here", ""),
        (f"{x}a", f"{SKOS}altLabel", 'A "quoted"; thing, x:b', ""), (f"{x}b", f"{SKOS}broader", f"{x}a", None), (f"{x}c", f"{x}size", "7", None), (f"{x}c", f"{x}size", "1", ""), (f"{x}d", f"{SKOS}broader", f"{x}b", None),
    ):
        assert want in rows, want
    assert len(rows) == 23
    assert sorted(r["text"].split()[0] for r in turtle.unread(spark, str(tmp_path)).collect()) == ["x:l", "x:m"]
    names = {r["node"][len(x) :]: r["label"] for r in turtle.labels(got).collect()}
    assert names == {"top": "Top", "a": 'A "quoted"; thing, x:b', "b": "B", "c": "C c", "d": "D", "p": "P", "q": "Q", "n": "n"}
    a = names["a"]
    paths = sorted(r["path"] for r in turtle.paths(got).collect())
    assert paths == sorted([["Top", "B", "C c"], ["Top", "B", "D"], ["Top", a, "B", "C c"], ["Top", a, "B", "D"], ["n"]])


def test_key_phrases(spark):
    docs = [(1, "The deep neural network of a small deep network. A network!"), (2, "Deep neural network, it's l'été and the small 3 networks"), (3, None), (4, ""), (4, "the of")]
    runs = keyphrases.candidates(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", ("the", "of", "a", "and", "it's")).cache()
    have = Counter((r["id"], r["phrase"]) for r in runs.collect())
    assert have == Counter([(1, "deep neural network"), (1, "small deep network"), (1, "network"), (2, "deep neural network"), (2, "l'été"), (2, "small"), (2, "networks")])
    freq, degree, ends = Counter(), Counter(), Counter()
    for (_, p), n in have.items():
        words = p.split()
        freq.update({w: n for w in words})
        degree.update({w: n * len(words) for w in words})
        ends[words[-1]] += n
    got = {r["phrase"]: (r["n"], r["n_docs"], round(r["score"], 9)) for r in keyphrases.scored(runs).collect()}
    assert got["deep neural network"] == (2, 2, round(sum(degree[w] / freq[w] for w in "deep neural network".split()), 9)) and got["small"][:2] == (1, 1)
    heads = {r["phrase"]: (r["head"], r["modifiers"]) for r in keyphrases.heads(runs).collect()}
    assert heads["deep neural network"] == ("network", "deep neural") and heads["small"] == ("small", "")
    assert {(r["phrase"], r["parent"], r["modifier"]) for r in keyphrases.parents(runs).collect()} == {("deep neural network", "network", "deep neural"), ("small deep network", "network", "small deep")}


def test_phrases_follow_numbers(spark):
    """What is shuffled for words and tails holds a phrase's number, not its text."""
    runs = spark.createDataFrame([(1, "deep red net"), (2, "net"), (2, "red net"), (3, "red net")], "id long, phrase string")
    assert sorted((*x[:3], round(x[3], 9)) for x in keyphrases.scored(runs).collect()) == [("deep red net", 1, 1, round(3 + 7 / 3 + 8 / 4, 9)), ("net", 1, 1, 2.0), ("red net", 2, 2, round(7 / 3 + 2, 9))]
    assert keyphrases._with_words(keyphrases.counted(runs)).columns == ["_no", "i", "freq", "degree", "ends"]
    assert {(r["phrase"], r["parent"]) for r in keyphrases.parents(runs).collect()} == {("deep red net", "red net"), ("red net", "net")}
