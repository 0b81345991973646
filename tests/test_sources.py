import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import ingest, ledger, resolve
from marketloom.schemas import COLUMN_HEADER, TABLES
from marketloom.sources import listing, rawstore, sheets

HEADER = [c.title() for c in COLUMN_HEADER]


def grid(spark, rows, sha="f"):
    data = [(sha, i, r[1] if isinstance(r, tuple) else 0, r[0] if isinstance(r, tuple) else r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, TABLES["cells"])


def line(group, name, low="12", high="14", spec="", unit="kilo"):
    return [group, name, spec, unit, low, high, high, low]


def parsed(spark, rows):
    return {r.commodity: r for r in sheets.price_rows(grid(spark, rows)).collect()}


def test_groups(spark):
    page = [(HEADER, 1), (line("NUTS", "walnut"), 1), (line(None, "pecan"), 1), (line("", "fig"), 1), (line("DRIED FRUIT", "date"), 1)]
    after = [(HEADER, 2), (line("", "prune"), 2), (line("", "raisin"), 2), (line("SPREADS", "tahini"), 2), (line(None, "honey"), 2), (line("", "jam"), 2)]
    got = {k: r.group for k, r in parsed(spark, page + after).items()}
    assert got == {"walnut": "NUTS", "pecan": "NUTS", "fig": "DRIED FRUIT", "date": "DRIED FRUIT", "prune": "DRIED FRUIT", "raisin": "SPREADS", "tahini": "SPREADS", "honey": "SPREADS", "jam": "SPREADS"}
    assert "before any commodity group" in parsed(spark, [HEADER, line(None, "stray")])["stray"].reject_reason
    between = [HEADER, line("OILS", "olive"), ["Note: weekly"] + [""] * 7, ["Market Monitored", ": x"] + [""] * 6, ["", " "] + [""] * 6, ["short"], line(None, "sesame")]
    assert {r.group for r in parsed(spark, between).values()} == {"OILS"} and len(parsed(spark, between)) == 2


def test_group_fill_against_a_plain_model(spark):
    rnd = random.Random(3)
    rows = [(line(rnd.choice(["A", "B", None, "", ""]), rnd.choice(["x", "x", "x", ""])), i // 7) for i in range(400)]
    got = [r.group for r in sheets.with_groups(sheets.classified(grid(spark, rows))).orderBy("row_no").collect()]
    now, want, pages = None, [], set()
    for i, (cells, page) in enumerate(rows):
        data = cells[1] != ""
        opens = data and page not in pages
        pages |= {page} if data else set()
        if data and cells[0]:
            now = cells[0]
        elif data and cells[0] == "" and not opens:
            now = next((c[0] for c, _ in rows[i:] if c[1] and c[0]), now)
        want.append(now)
    assert got == want


def test_rows_are_typed_or_refused(spark):
    rows = [line("G", "word", low="dear"), line("G", "sign", low="-3"), line("G", "turned", low="30.10", high="30"), line("G", "bare", unit=" "), line("G", "double", low="4\n5"), line("G", "fine", low=" 2,040.5", high="2,100", unit="KG", spec="Kg"), line("G", "blank", low="\n", high="")]
    got = parsed(spark, [HEADER, *rows])
    assert got["word"].reject_reason == "not a number: dear" and got["sign"].reject_reason.startswith("not a number") and got["turned"].reject_reason == "low 30.10 is above high 30.00"
    assert got["bare"].reject_reason == "row has no unit" and got["double"].reject_reason.startswith("several values")
    assert got["fine"].reject_reason is None and str(got["fine"].low) == "2040.50" and got["fine"].unit == "kg" and got["fine"].specification is None
    assert got["blank"].unavailable and got["blank"].reject_reason is None
    n = sheets.unavailable_per_sheet(sheets.price_rows(grid(spark, [HEADER, *rows]))).collect()
    assert [(r.rows, r.unavailable) for r in n] == [(2, 1)]


def test_files_without_column_header_are_refused_whole(spark):
    cells = grid(spark, [line("G", "x")], "rows").union(grid(spark, [["only", "two"]], "none")).union(grid(spark, [HEADER], "empty"))
    assert {r.file_sha for r in sheets.refused_files(cells).collect()} == {"rows", "none"}


def test_of_each_page_the_largest_table_counts(spark):
    files = spark.createDataFrame([("s", b"1")], "sha256 string, content binary")
    tables = [(2, [["c"]]), (1, [["a"]]), (1, [["b"], ["d"]]), (1, [["e"], ["f"]])]
    got = sheets.extract(files, lambda content: tables).orderBy("row_no").collect()
    assert [(r.page, r.cells) for r in got] == [(1, ["b"]), (1, ["d"]), (2, ["c"])]


def test_sheet_header(spark):
    full = "Province: Lanao\n  MUNICIPALITY :  New   Town\nMarket Monitor : Night stalls\nDate of Mon: 7 March 2020\nProvince: Other\nDate of Monitoring: none"
    df = spark.createDataFrame([("a", full), ("b", "Province: X\nMarket Monitored:"), ("c", full.replace("7 March 2020", "7 March"))], "file_sha string, text string")
    got = {r.file_sha: r for r in sheets.sheet_headers(df).collect()}
    assert got["a"].reject_reason is None and (got["a"].province, got["a"].municipality, got["a"].market, str(got["a"].observed_on)) == ("Lanao", "New Town", "Night stalls", "2020-03-07")
    assert got["b"].reject_reason.startswith("header has no") and "no four-digit year" in got["c"].reject_reason


HTML = """<p>a<b</p><!-- <a href="/hidden.csv">no</a> --><script>var x = '<a href="/script.csv">';</script>
<A class=k HREF='/q/list 9 May 2019.csv?a=1&amp;b=2#top'> 9&nbsp;May <em>2019</em> </A><a href="/q/list 9 May 2019.csv?a=1&amp;b=2">again</a><a name="here">nowhere</a>
<a title="a > b" href="../up/./revised-4-June-2018.csv">outer <a href=notes.csv>inner</a> tail<a href="ftp://h/x.csv">f</a><a href="#part">p</a><a href="?page=2">next</a><a href="//CDN.example/List-1-May-2017.csv">open <i>end"""


def test_anchors_and_entries(spark):
    assert [(h, t) for h, t in listing.links_of(HTML)] == [
        ("/q/list 9 May 2019.csv?a=1&b=2#top", "9 May 2019"), ("/q/list 9 May 2019.csv?a=1&b=2", "again"), (None, "nowhere"), ("../up/./revised-4-June-2018.csv", "outer"), ("notes.csv", "inner"),
        ("ftp://h/x.csv", "f"), ("#part", "p"), ("?page=2", "next"), ("//CDN.example/List-1-May-2017.csv", "open end"),
    ]
    pages = spark.createDataFrame([(1, "HTTP://H.example/in/dex/page.html?x#y", HTML), (2, None, None), (3, "http://h.example", "")], "page_id long, url string, html string")
    links = listing.anchors(pages)
    assert links.count() == 9
    judged = listing.entries(listing.candidates(links, r"(?i)\.csv").repartition(3))
    got = {r.filename: r for r in judged.collect()}
    assert got["list 9 May 2019.csv"].times == 2 and got["list 9 May 2019.csv"].date_source == "link_text" and str(got["list 9 May 2019.csv"].observed_on) == "2019-05-09"
    assert got["revised-4-June-2018.csv"].target == "http://h.example/in/up/revised-4-June-2018.csv" and got["revised-4-June-2018.csv"].is_revision and got["revised-4-June-2018.csv"].date_source == "filename"
    assert got["notes.csv"].target == "http://h.example/in/dex/notes.csv" and "nor in filename" in got["notes.csv"].reason
    assert got["List-1-May-2017.csv"].target == "http://cdn.example/List-1-May-2017.csv"
    n = listing.counters(judged).first()
    assert (n.candidates, n.duplicates, n.entries, n.rejected) == (5, 1, 3, 1) and n.rejection_rate == 0.25


def test_addresses_as_the_library_joins_them(spark):
    from urllib.parse import urljoin

    bases = ["http://h.example/a/b/c.html", "http://h.example/a/", "http://h.example", "https://h.example/x?q=/1"]
    hrefs = ["d.csv", "./d", "../d", "../../../d", "/r/../s", "e/..", "e/.", "x//y/../z", "?q=2", "https://o.example/./p", "//o.example/q", "mailto:a@b", "f?x=../y", "#frag"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string").withColumn("got", listing.absolute("b", "h"))
    for r in df.collect():
        assert r.got == urljoin(r.b, r.h), (r.b, r.h)
    assert spark.createDataFrame([(None, "x"), ("ftp://z", "x")], "b string, h string").select(listing.absolute("b", "h").alias("a")).filter("a is not null").isEmpty()


def fetched(spark, rows):
    return spark.createDataFrame([(*r, "t", 200) for r in rows], "url string, content binary, fetched_at long, content_type string, http_status int")


def test_raw_store(spark, tmp_path):
    df = fetched(spark, [("http://S.example/one#x", b"aa", 1), ("http://s.example/one", b"aa", 2), ("http://s.example/two", b"bb", 1), ("http://s.example/two", b"cc", 2), ("gopher://s", b"dd", 1)])
    manifest = rawstore.manifest_of(df)
    assert manifest.count() == 2 and [r.url for r in rawstore.conflicts(df).collect()] == ["http://s.example/two"]
    want = spark.createDataFrame([("http://s.example/one",), ("http://s.example/three",)], "target string")
    assert [r.target for r in rawstore.to_fetch(want, manifest).collect()] == ["http://s.example/three"]
    path = f"file://{tmp_path}/blobs"
    rawstore.write_blobs(df, path)
    rawstore.write_blobs(df.limit(3), path)
    assert rawstore.stored_blobs(spark, path).count() == 4
    blobs = rawstore.stored_blobs(spark, path)
    assert rawstore.verify(manifest, blobs).isEmpty() and [bytes(r.content) for r in rawstore.entries(manifest, blobs).collect()] in ([b"aa", b"bb"], [b"bb", b"aa"])
    broken = blobs.withColumn("content", F.when(F.col("content") == F.lit(b"aa"), F.lit(b"ab")).otherwise(F.col("content"))).filter(F.col("content") != F.lit(b"bb"))
    assert sorted(r.problem[:15] for r in rawstore.verify(manifest, broken).collect()) == ["blob missing", "content hashes "]
    rawstore.checked(df.limit(2), manifest)
    with pytest.raises(rawstore.CacheConflict):
        rawstore.checked(fetched(spark, [("http://s.example/one", b"zz", 9)]), manifest)


def test_text_rules(spark):
    df = spark.createDataFrame([("\u00a0x  y\x1f z\t", "Grams", "PROVINCE  OF   Cebu ", "10,500.5", "Municipality/C"), (None, "pallet", "Cebu", " ", "Date")], "a string, u string, p string, m string, l string")
    got = df.select(text.collapse(F.col("a")), text.normalise_unit(F.col("u")), text.normalise_place(F.col("p")), text.read_amount(F.col("m"))["value"].cast("string"), text.field_for(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("x y z", "g", "cebu", "10500.50", "municipality"), ("", "pallet", "cebu", None, None)]


def dims(spark):
    return {
        "commodities": spark.createDataFrame([("oil", "L"), ("salt", "bag")], "canonical_slug string, unit string"),
        "commodity_aliases": spark.createDataFrame([("oils | olive | ", "oil"), ("salts | sea | fine", "salt")], "alias_key string, canonical_slug string"),
        "regions": spark.createDataFrame([("01", "Province of Cebu", "province"), ("02", "Bohol", "province"), ("03", "Lanao", "region")], TABLES["regions"]),
        "markets": spark.createDataFrame([(7, "01", "Night Stalls", "New Town")], TABLES["markets"]),
    }


def test_resolution(spark):
    d = dims(spark)
    rows = spark.createDataFrame([("Oils", "OLIVE ", None, "L"), ("Salts", "Sea", "Fine", "kg"), ("Salts", "Sea", "coarse", "bag")], "group string, commodity string, specification string, unit string")
    got = [r.canonical_slug or r.alias_reason for r in resolve.resolve_commodities(rows, d["commodity_aliases"], d["commodities"]).orderBy("group", "unit").collect()]
    assert got == ["oil", "no alias for 'salts | sea | coarse'", "unit 'kg' does not match 'bag' recorded for 'salt'"]
    assert resolve.resolution_rate(resolve.resolve_commodities(rows, d["commodity_aliases"], d["commodities"])).first().rate == pytest.approx(1 / 3)
    resolve.refuse_dangling(d["commodity_aliases"], d["commodities"])
    with pytest.raises(ValueError, match="sea"):
        resolve.refuse_dangling(d["commodity_aliases"], d["commodities"].filter("unit = 'L'"))


def test_provinces(spark):
    rows = spark.createDataFrame([(" cebu",), ("Province of Bohol",), ("Lanao",), ("Atlantis",), (None,)], "province string")
    got = {r.province: r.psgc_code for r in resolve.resolve_provinces(rows, dims(spark)["regions"]).collect()}
    assert got == {" cebu": "01", "Province of Bohol": "02", "Lanao": None, "Atlantis": None, None: None}


def test_seeds(spark, tmp_path):
    folder = tmp_path / "seed"
    folder.mkdir()
    for name, lines in {
        "commodities": ["canonical_slug,group,name,specification,unit", "oil,OILS,olive,,L"], "commodity_aliases": ["alias_key,canonical_slug", "oils | olive | ,oil"],
        "regions": ["psgc_code,name,level", "01,Cebu,province"], "sources": ["slug,name,base_url,licence,attribution_text", "s,S,http://s.example,,by S"],
    }.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    seed = resolve.load_seed(spark, f"file://{folder}")
    assert seed["commodities"].first().specification is None and seed["sources"].first().licence is None and seed["commodity_aliases"].first().alias_key == "oils | olive | "
    dim = spark.createDataFrame([(1, "oil", "OLD", "olive", None, "L"), (2, "salt", "SALTS", "sea", None, "kg")], TABLES["commodities"])
    columns = ["group", "name", "specification", "unit"]
    new = seed["commodities"].union(spark.createDataFrame([("rice", "GRAIN", "rice", None, "kg")], seed["commodities"].schema))
    assert {r.canonical_slug: r.kind for r in resolve.seed_changes(dim, new, "canonical_slug", columns).collect()} == {"oil": "updated", "rice": "inserted"}
    after = resolve.seeded(dim, new, "canonical_slug", columns)
    assert {(r.canonical_slug, r["group"]) for r in after.collect()} == {("oil", "OILS"), ("salt", "SALTS"), ("rice", "GRAIN")} and {r.id for r in after.filter("canonical_slug <> 'rice'").collect()} == {1, 2}
    assert {r.kind for r in resolve.seed_changes(after, new, "canonical_slug", columns).collect()} == {"unchanged"} and sorted(resolve.seeded(after, new, "canonical_slug", columns).collect()) == sorted(after.collect())


def test_drift(spark):
    rows = spark.createDataFrame([("s1", "OILS", "olive", None), ("s2", "OILS", "olive", None), ("s3", "OILS", "palm", None), ("s1", "SALTS", "sea", "x"), ("s3", "SALTS", "sea", "x")], "sheet string, group string, commodity string, specification string")
    aliases = dims(spark)["commodity_aliases"]
    assert {(r.alias_key, r.kind) for r in resolve.drift(aliases, rows).collect()} == {("salts | sea | x", "missing"), ("salts | sea | fine", "unattested")}


def test_ledger(spark):
    rows = spark.createDataFrame([(1, "bad"), (2, None)], "row_no int, why string")
    held = ledger.held(rows, "parse", F.col("why"), ["row_no"], "s", "r").collect()
    assert len(held) == 1 and held[0].payload == '{"row_no":1}'
    assert [ledger.status_of(*x) for x in ((False, 0), (True, 1), (True, 0))] == ["failed", "partial", "succeeded"]
    assert [ledger.EXIT_CODES[x] for x in ("succeeded", "failed", "partial")] == [0, 1, 2]
    with pytest.raises(ValueError):
        ledger.held(rows, "elsewhere", F.col("why"), ["row_no"], "s", "r")


def test_ingest_end_to_end(spark):
    def head(province="Cebu", town="new  TOWN", market="night stalls", day="3 May 2020"):
        return f"Province: {province}\nMunicipality/City: {town}\nMarket Monitored: {market}\nDate of Monitoring: {day}"

    files = {
        "a": (head(), [HEADER, line("OILS", "olive", "10", "12", unit="liter"), line("SALTS", "sea", spec="fine", unit="bag"), line("SALTS", "rock")]),
        "b": (head(day="4 May 2020", town="Harbour"), [HEADER, line("OILS", "olive", "11", "12", unit="l"), line("OILS", "olive", "11", "13", unit="l"), line("SALTS", "sea", "x", spec="fine", unit="bag")]),
        "c": (head(town="New Town"), [HEADER, line("OILS", "olive", "10.5", "12", unit="liter")]),
        "d": (head(province="Atlantis"), [HEADER, line("OILS", "olive", unit="liter")]), "e": (head(day="4 May 2031"), [HEADER, line("OILS", "olive", unit="liter")]),
        "f": (head(day="soon"), [HEADER, line("OILS", "olive", unit="liter")]), "g": (head(), [line("OILS", "olive", unit="liter")]),
    }
    cells = spark.createDataFrame([(f, i, 0, r) for f, (_, rows) in files.items() for i, r in enumerate(rows)], TABLES["cells"])
    texts = spark.createDataFrame([(f, t) for f, (t, _) in files.items()], "file_sha string, text string")
    headers = sheets.sheet_headers(texts).withColumn("file_seq", F.ascii("file_sha"))
    now = F.lit("2026-01-01").cast("timestamp")

    def run(stored):
        return ingest.ingest(cells, headers, stored, dims(spark), "s", "r1", F.lit("2026-01-01").cast("date"), now)

    done = run(spark.createDataFrame([], TABLES["price_observations"]))
    assert [(r.region_psgc_code, r.municipality, r.name) for r in done.markets.collect()] == [("01", "Harbour", "night stalls")]
    got = {(r.market, r.commodity): (str(r.low), r.revision_no, r.source_file_sha256) for r in done.upsert.state.collect()}
    assert got == {(7, "oil"): ("10.50", 1, "c"), (7, "salt"): ("12.00", 0, "a")}
    assert [(str(r.low), r.revision_no, r.source_file_sha256) for r in done.upsert.revisions.collect()] == [("10.00", 0, "a")]
    assert done.upsert.outcome.first().asDict() == dict(inserted=2, revised=1, unchanged=0, conflicts=1, rejected=2)
    held = sorted((r.source_file_sha256, r.stage, r.reason[:26]) for r in done.quarantine.collect())
    assert held == [
        ("a", "alias", "no alias for 'salts | rock"), ("b", "parse", "not a number: x"), ("b", "validate", "2 rows in one batch resolv"), ("d", "validate", "province 'Atlantis' is not"),
        ("e", "validate", "sheet is dated 2031-05-04,"), ("f", "parse", "unreadable Date of Monitor"), ("g", "parse", "no column header row"),
    ]
    assert ingest.run_summary(done).first().asDict() == dict(files_seen=7, files_failed=4, rows_upserted=3, rows_quarantined=7, status="partial")
    again = run(spark.createDataFrame(done.upsert.state.collect(), TABLES["price_observations"]).withColumn("ingested_at", F.lit("2020-01-01").cast("timestamp")))
    # A second run of all files: the first sheet's price comes and goes again.
    assert {(r.market, r.commodity): str(r.low) for r in again.upsert.state.collect()} == {(7, "oil"): "10.50", (7, "salt"): "12.00"}
