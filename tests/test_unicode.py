"""Character entities and case folding against Python's own, XML with mixed content."""

import html
import random
import sys
from html.entities import html5

from pyspark.sql import functions as F

from graphloom.functions import unicode as U
from graphloom.functions.text import clean_text
from graphloom.sources import records as S


def apply(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(4)
    out = df.select("i", f(F.col("t")).alias("r"))
    assert "Python" not in out._jdf.queryExecution().toString()
    return [r["r"] for r in out.orderBy("i").collect()]


def test_every_entity(spark):
    named = [f"&{n}" for n in html5] + [f"x&{n.rstrip(';')}y;z" for n in html5] + [f"&{n.rstrip(';')}; &{n[:3]} & &&{n}" for n in html5]
    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFE, 0x110000, 99999999, 10**30]
    numeric = [f"a&#{n}{end}b" for n in numbers for end in (";", "", " ")] + [f"&#{x}{n:x};&#{x}000{n:X}" for n in numbers for x in "xX"] + ["&#;", "&#x;", "&#xg", "&", "&&", "&;", "& amp;", "a&amp;lt;b", ""]
    rng = random.Random(2)
    mixed = ["".join(rng.choice(["&", "amp", "lt", "#", "x41", "65", ";", " ", "<", "notit", "é", "&copy", "&notin;", "a" * 40]) for _ in range(12)) for _ in range(800)]
    for values in (named, numeric, mixed):
        got = apply(spark, values, U.unescape)
        wrong = [(v, g, html.unescape(v)) for v, g in zip(values, got) if g != html.unescape(v)]
        assert not wrong, wrong[:5]
    assert apply(spark, ["&lt;b&gt; \x0b&nbsp;x&amp;amp; \n"], clean_text) == ["<b> x&amp;"]
    assert apply(spark, [None], U.unescape) == [None]


def test_every_code_point_folds(spark):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    values = ["".join(map(chr, points[i : i + 500])) for i in range(0, len(points), 500)]
    values += [chr(c) for c in points if chr(c).casefold() != chr(c)] + ["Straße ΣΑΣ İstanbul ŉ ﬃ", "ABC z", "", None]
    got = apply(spark, values, U.casefold)
    wrong = [(v, g) for v, g in zip(values, got) if g != (v if v is None else v.casefold())]
    assert not wrong, wrong[:3]


ARTICLE = """<PubmedArticle>
  <MedlineCitation Status="a > b"><PMID Version="1">%d</PMID><!-- <PMID>9</PMID> -->
   <Article><Journal><JournalIssue><PubDate><Year>2024</Year><Month>Jan</Month></PubDate></JournalIssue><Title>J &amp; K</Title></Journal>
    <ArticleTitle>On <i>very <b>deep</b></i> <mml:math xmlns:mml="u"><mml:mi>x</mml:mi></mml:math> &lt; <![CDATA[y <z> &amp; w]]>&#233;.</ArticleTitle>
    <Abstract><AbstractText Label='A "q" >'>First<sup>2</sup> part.</AbstractText><AbstractText/><AbstractText>Second<?pi x?> part</AbstractText></Abstract></Article>
   <MeshHeadingList><MeshHeading><DescriptorName UI="D1">Heart <e>x</e></DescriptorName></MeshHeading><MeshHeading><DescriptorName> </DescriptorName><QualifierName>q</QualifierName></MeshHeading></MeshHeadingList>
  </MedlineCitation></PubmedArticle>"""


def test_articles_with_mixed_content_from_split_files(spark, tmp_path):
    n = 300
    head = '<?xml version="1.0"?>\n<!DOCTYPE PubmedArticleSet>\n<PubmedArticleSet>\n'
    (tmp_path / "a.xml").write_text(head + "\n".join(ARTICLE % i for i in range(n)) + "\n<PubmedArticle><MedlineCitation><Article/></MedlineCitation></PubmedArticle></PubmedArticleSet>")
    (tmp_path / "b.xml").write_text(head + ARTICLE % 1000 + "</PubmedArticleSet>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = S.read_elements(spark, str(tmp_path), "PubmedArticle")
        assert raw.rdd.getNumPartitions() > 5
        rows = S.parse_articles(raw).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(int(r["pmid"]) for r in rows) == [*range(n), 1000]
    # references of a CDATA section are text; cleaning then resolves those that are left, as it does for any text
    want = ("On very deep x < y <z> & wé.", "First2 part. Second part", "J & K", "2024-Jan", ["Heart x"])
    assert {(r["title"], r["abstract"], r["journal"], r["publication_date"], tuple(r["mesh_terms"])) for r in rows} == {(*want[:4], tuple(want[4]))}
