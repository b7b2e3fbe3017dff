import io
import zipfile

import pytest
from pyspark.sql import functions as F

from geolith.functions import text
from geolith.sources import readers
from geolith.streaming import events as stream


def one(spark, column, value, name="x", kind="string"):
    return spark.createDataFrame([(value,)], f"{name} {kind}").select(column.alias("y")).first().y


def test_cleaning_functions(spark):
    assert one(spark, text.normalize_key(F.col("x")), " Côte d'Ivoire (2020) ") == "c_te_d_ivoire_2020"
    assert one(spark, text.strip_markdown(F.col("x")), "## Head\n- **bold** and [link](http://x) `code`") == "Head\nbold and link code"
    assert one(spark, text.repair_mojibake(F.col("x")), "CÃ´te d'Ivoire") == "Côte d'Ivoire"
    assert one(spark, text.repair_mojibake(F.col("x")), "Côte") == "Côte"
    assert one(spark, text.tokens(F.col("x")), "The  UN, re-elected a x1y!") == ["the", "reelected", "x1y"]
    assert one(spark, text.sentences(F.col("x")), 'It rained. "Yes," he said. e.g. this! 3 more?') == ["It rained.", '"Yes," he said. e.g. this!', "3 more?"]
    assert one(spark, text.folded(F.col("x")), " Curaçao ") == "curacao"


def test_terms_and_verdicts(spark):
    assert one(spark, text.mentions(F.col("x"), ["Turkey", "UK"]), "turkeys, UK, uk, Turkeyish") == ["turkeys", "UK"]
    docs = spark.createDataFrame(
        [(1, "China met India. Done."), (2, "China, India, Peru and Chad attended."), (3, "China alone."), (4, "Nobody."), (5, None)],
        "id int, t string",
    )
    found = {r.id: r.verdict for r in text.verdict(docs, "id", "t", ["China"], ["India"], ["China", "India", "Peru", "Chad"]).collect()}
    assert found == {1: "together", 2: "listed", 3: "one_sided", 4: "none", 5: "unavailable"}
    snippet = text.term_snippets(docs, "id", "t", ["India"]).orderBy("id").first()
    assert snippet.snippets == ["China met India. Done."]


def test_urls(spark):
    assert one(spark, text.slug_words(F.col("x")), "https://a.example/news/2024/big-storm-hits-coast.html") == ["big", "storm", "hits", "coast"]
    assert one(spark, text.safe_url(F.col("x")), "http://127.0.0.1/x") is False
    assert one(spark, text.safe_url(F.col("x")), "https://a.example/x") is True
    assert one(spark, text.safe_url(F.col("x")), "ftp://a.example/x") is False


@pytest.mark.parametrize(("a", "b", "d"), [("indai", "india", 1), ("abc", "abc", 0), ("abc", "xyz", 3), ("a", "abcd", 3), ("brasil", "brazil", 1)])
def test_edit_distance_with_swaps(a, b, d):
    assert text.osa_distance(a, b) == d


def test_article_paragraphs():
    long = "A paragraph that is long enough to be kept as text of an article. " * 5
    html = f"<nav><p>{long}menu</p></nav><p>{long}outside</p><article><p>{long}one</p><p>short</p><p>{long}two<script>x()</script></p><p>{long}one</p></article>"
    found = text.paragraphs(html)
    assert [p.split()[-1] for p in found] == ["one", "two"]
    assert text.paragraphs(None) == []


def workbook(rows):
    strings = sorted({v for r in rows for v in r if isinstance(v, str)})
    shared = "".join(f"<si><t>{s}</t></si>" for s in strings)

    def cell(c, v):
        return f'<c r="{c}" t="s"><v>{strings.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{c}"><v>{v}</v></c>'

    body = "".join(f"<row>{''.join(cell(f'{chr(65 + j)}{i + 1}', v) for j, v in enumerate(r))}</row>" for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks_and_codebooks(spark, tmp_path):
    (tmp_path / "votes.xlsx").write_bytes(workbook([["MS_Vote", "Date"], ["Y", 36526], ["N", 36892]]))
    rows = readers.read_workbooks(spark, str(tmp_path / "votes.xlsx"), ["ms_vote", "date"]).collect()
    assert [(r.ms_vote, readers.excel_year(float(r.date))) for r in rows] == [("Y", 2000), ("N", 2001)]
    lines = ["region:", "1 = Europe", "2) Asia", "noise", "type", "1: war"]
    df = spark.createDataFrame([("ucdp", i, x) for i, x in enumerate(lines)], "dataset string, line_no int, line string")
    codes = readers.codebook_lines(df)
    assert {(r.column, r.code, r.label) for r in codes.collect()} >= {("region", "1", "Europe"), ("region", "2", "Asia"), ("type", "1", "war")}
    data = spark.createDataFrame([("1.0",), ("9",)], "region string")
    assert {r.region_label for r in readers.decode(data, codes, "ucdp", "region").collect()} == {"Europe", "9"}


def test_all_sheets_are_read(spark, tmp_path):
    first, second = (io.BytesIO(workbook([["Name", "N"], [name, 1]])) for name in ("one", "two"))
    out = io.BytesIO()
    with zipfile.ZipFile(first) as a, zipfile.ZipFile(second) as b, zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", a.read("xl/worksheets/sheet1.xml").replace(b' t="s"><v>1', b' t="str"><v>one'))
        z.writestr("xl/worksheets/sheet2.xml", b.read("xl/worksheets/sheet1.xml"))
        z.writestr("xl/sharedStrings.xml", b.read("xl/sharedStrings.xml"))
    rows = list(readers.workbook_rows(out.getvalue()))
    assert len(rows) == 2 and rows[1]["name"] == "two"


def test_encoding_is_guessed_for_each_file(spark, tmp_path):
    assert readers.sniff(("x" * 65535 + "é").encode()[:65536]) == ("utf-8", ",")
    (tmp_path / "a.csv").write_bytes("name;x\nCôte;1\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("name,y\nÎle,2\n".encode())
    rows = readers.read_delimited(spark, str(tmp_path / "*.csv")).collect()
    assert sorted((r.name, r.x, r.y) for r in rows) == [("Côte", "1", None), ("Île", None, "2")]


def test_trade_files_and_partitioned_sink(spark, tmp_path):
    for year in (2000, 2001):
        (tmp_path / f"BACI_HS92_Y{year}_V1.csv").write_text(f"t,i,j,k,v,q\n{year},1,2,270900,5,1\n{year},1,2,271000,6,\n{year},1,3,10100,7,2\n{year},1,9,10100,7,2\n")
    raw = readers.read_baci(spark, str(tmp_path / "*.csv"))
    assert readers.available_years(raw) == [2000, 2001]
    names = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "country_code int, country_name string")
    flows = readers.baci_flows(raw, names)
    assert sorted((r.year, r.importer, r.sector, r.trade_value) for r in flows.collect())[:2] == [(2000, "B", "energy", 11.0), (2000, "C", "agriculture", 7.0)]
    out = str(tmp_path / "edges")
    readers.write_years(flows, out)
    readers.write_years(flows.where("year = 2001").limit(1), out)
    counts = {r.year: r["count"] for r in spark.read.parquet(out).groupBy("year").count().collect()}
    assert counts == {2000: 2, 2001: 1}
    assert '"2000": 2' in readers.manifest(spark.read.parquet(out))


def test_other_files(spark, tmp_path):
    (tmp_path / "day.tsv").write_text("\t".join(f"v{i}" for i in range(58)) + "\n")
    row = readers.read_gdelt(spark, str(tmp_path / "day.tsv")).first()
    assert (row.sql_date, row.a1, row.url) == ("v1", "v7", "v57")
    (tmp_path / "gge.csv").write_text("a,b,ca,cb,year,s,d\nUSA,CHN,1,2,1995,0.12345,0.5\nUSA,CHN,1,2,1980,1,1\nCHN,USA,2,1,1994,,1\n")
    series = readers.dyad_series(readers.read_dyads(spark, str(tmp_path / "gge.csv"))).first()
    assert series.dyad == "CHN-USA" and [tuple(x) for x in series.series] == [(1995, 0.1235, 0.5)]
    (tmp_path / "latin.csv").write_bytes("name;x\nCôte;1\n".encode("cp1252"))
    assert readers.read_delimited(spark, str(tmp_path / "latin.csv")).first().name == "Côte"
    (tmp_path / "wb.json").write_text('[{"page":1},[{"countryiso3code":"USA","date":"2000","value":5.5},{"countryiso3code":"","date":"2000","value":1},{"countryiso3code":"FRA","date":"2001","value":null}]]')
    assert [tuple(r) for r in readers.read_world_bank(spark, str(tmp_path / "wb.json"), "gdp").collect()] == [("USA", 2000, 5.5)]
    assert readers.choose_files(["a/Votes_v2.xlsx", "b/votes.csv", "long/er/votes.csv", "x.txt"]) == {"votes": "b/votes.csv"}


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.read_events(spark, str(tmp_path / "in"), source.schema)
    found = stream.run_available(stream.tumbling(live), "daily", str(tmp_path / "c1"), "complete")
    key = ["window_start", "event_type"]
    assert found.select(*key, "n").exceptAll(stream.tumbling(source).select(*key, "n")).count() == 0
    doubled = source.union(source)
    doubled.write.parquet(str(tmp_path / "twice"))
    once = stream.run_available(stream.deduplicated(stream.read_events(spark, str(tmp_path / "twice"), source.schema)), "once", str(tmp_path / "c2"))
    assert once.count() == source.count()
    assert stream.tumbling(source, "1 day", "12 hours").count() > stream.tumbling(source).count()


def test_filter_state_lives_on_between_runs(spark, tmp_path):
    schema = "iso3 string, period long, value double"
    folder = str(tmp_path / "updates")
    spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], schema).write.mode("append").parquet(folder)
    source = spark.read.parquet(folder).schema

    def run(name):
        live = spark.readStream.schema(source).parquet(folder)
        return stream.run_available(stream.incremental_filter(live, 0.5, 1.0), name, str(tmp_path / f"cp-{name}"), "append")

    first = {r.period: (r.state, r.variance) for r in run("first").collect()}
    assert first[1] == (1.0, 1.0) and first[2][0] == pytest.approx(1 + 1.5 / 2.5)
    spark.createDataFrame([("A", 3, None), ("A", 2, 9.0)], schema).write.mode("append").parquet(folder)
    both = run("both").orderBy("period").collect()
    assert len(both) >= 3 and both[-1].period == 3


def test_headlines_and_placeholders():
    page = '<head><title>Short</title><meta property="og:title" content="A storm hits the northern coast | Example News"></head><h1>Other heading of the page here</h1>'
    assert text.headline(page) == "A storm hits the northern coast"
    assert text.headline("<h1>Tiny</h1><title>The title of this page is long enough</title>") == "The title of this page is long enough"
    assert text.article("<p>Please enable JavaScript to read on, as this site needs it for all pages.</p>")[2]
    long = "A sentence of an article that goes on for a while and says something of note. " * 4
    title, body, placeholder = text.article(page + f"<article>{''.join(f'<p>{i} {long}</p>' for i in range(9))}</article>")
    assert len(body) == 1201 and body.endswith("…") and not placeholder


def test_progress_is_told(spark, tmp_path):
    import time

    from geolith.streaming.progress import Progress

    told = []
    listener = Progress(told.append)
    spark.streams.addListener(listener)
    spark.range(5).selectExpr("id AS event_id", "current_timestamp() AS ts").write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in")).schema
    stream.run_available(stream.deduplicated(stream.read_events(spark, str(tmp_path / "in"), source)), "told", str(tmp_path / "c"))
    for _ in range(50):
        if any(x["stage"] == "done" for x in told):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert {"started", "batch", "done"} <= {x["stage"] for x in told}
    assert sum(x.get("rows", 0) for x in told) == 5
