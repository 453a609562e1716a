import itertools
import json
import math
import random

from pyspark.sql import functions as F

from plenum.operators import enrich, incremental, mining, search, sequence, stats, tokenize
from plenum.operators import names as names_op
from plenum.sources import meetings, sinks
from plenum.streaming import ingest


def test_overlap():
    assert sequence.repeated_prefix("aaa bbb ccc dddd eeee", "ccc dddd eeee") == 13
    assert sequence.repeated_prefix("one two three four five", "xthree four five six seven") == len("xthree four five")
    assert sequence.repeated_prefix("abc", "def") == 0 and sequence.repeated_prefix(None, "x") == 0 and sequence.repeated_prefix("x", "") == 0


def _model(rows):
    """Attribution and runs in plain Python: rows (meeting, pos, site, marker)."""
    out, state = [], {}
    for m, pos, site, marker in rows:
        s = state.setdefault(m, {"site": object(), "carried": None, "who": object(), "run": 0})
        if s["site"] != site or isinstance(s["site"], type(object())) and s["site"] is not site and s["site"] != site:
            s["carried"] = None
        s["site"] = site
        if marker is not None:
            s["carried"] = marker
        who = s["carried"] if s["carried"] is not None and s["carried"] != site else site
        if who is None or who != s["who"]:
            s["run"] += 1
        s["who"] = who
        out.append((m, pos, who, s["run"]))
    return out


def test_attribution_and_runs(spark):
    rnd = random.Random(3)
    rows = [(m, i, rnd.choice([None, "a", "b"]), rnd.choice([None, None, "a", "c"])) for m in range(20) for i in range(25)]
    df = spark.createDataFrame(rows, "m int, pos int, site string, marker string")
    got = sequence.runs(sequence.attribute(df, "m", ["pos"], "site", "marker"), "m", ["pos"], "who")
    assert sorted(tuple(r) for r in got.select("m", "pos", "who", "run").collect()) == _model(rows)


def test_assembly_and_transcript(spark):
    df = spark.createDataFrame([("p", "1", 1, 0, "A", "00:00:01", "x"), ("p", "1", 1, 1, "A", "00:00:01", " "), ("p", "1", 1, 2, "B", "00:00:01", "y"), ("p", "1", 2, 0, "B", "00:05:00", "z")], "phase string, meeting_id string, seq int, pos int, speaker string, start_time string, text string")
    assert sequence.assemble(df, ["meeting_id"], ["seq", "pos"]).first()["text"] == "x   y z"
    assert sinks.json_rows(df.where("pos = 1").select(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"))).first()[0] == '{"a":1}'


def test_thai_segmentation():
    lex = tokenize.Lexicon({"ผม": 9000, "ขอ": 9000, "เสนอ": 5000, "แลนด์": 60, "บริดจ์": 60, "เสน": 50, "อ": 50, "คดี": 900, "โชคดี": 900}, phrases=["แลนด์บริดจ์"])
    assert lex.tokens("ผมขอเสนอแลนด์บริดจ์") == ["ผม", "ขอ", "เสนอ", "แลนด์บริดจ์"]
    assert lex.tokens("Thai PBS, 123 ผม") == ["thai", "pbs", "ผม"]
    assert lex.breaks("ผมโชคดี") == [0, 2, 7]
    assert lex.breaks("😀ผม") == [2, 4]
    assert lex.tokens("") == []


def test_rare_words_and_places():
    base = {"ทะเล": 900, "สาบ": 900, "กรุง": 900}
    assert tokenize.Lexicon(base, rare=["ทะเลสาบ", "ธนู"]).tokens("ทะเลสาบธนู") == ["ทะเล", "สาบ", "ธนู"]
    assert tokenize.Lexicon(base, places=["กรุงซาบา"]).tokens("กรุงซาบา") == ["กรุงซาบา"]


def test_mining_passes(spark):
    texts = spark.createDataFrame([("รถไฟฟ้าดี",)] * 12 + [(None,)], "t string")
    none = spark.createDataFrame([], "word string, tier string")
    found = mining.mine_passes(texts, "t", {"รถ": 900, "ไฟฟ้า": 900, "ดี": 90000}, none, none.select("word"))
    assert found["รถไฟฟ้า"] == ("corpus", 12)


def test_mining_reads_texts_once_a_pass(spark):
    """Every pass scans the texts once: no run of tokens that cannot be a phrase is counted, shuffled or cut again."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = [("รถไฟฟ้าดี", 1)] * 13 + [("รถไฟฟ้าดี", -1), (None, 1)]
    texts = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "t string, w int")
    none = spark.createDataFrame([], "word string, tier string")
    words = {"รถ": 900, "ไฟฟ้า": 900, "ดี": 90000}
    one = mining.mine_passes(texts.select("t"), "t", words, none, none.select("word"), passes=1)
    assert read.value == len(rows) and one["รถไฟฟ้า"] == ("corpus", 14)
    assert mining.mine_passes(texts, "t", words, none, none.select("word"), passes=1, weight="w")["รถไฟฟ้า"] == ("corpus", 12)
    # runs of up to five tokens that spell a word, single tokens and pairs of real words; nothing else
    lists = [(["a", "b", "c", "x"], 1), (["a", "b", "c"], 2), (["b", "c"], -1)]
    got = {}
    for parts, n in mining.tally(lists, {"abc", "bcx"}, {"a", "b"}):
        got[tuple(parts)] = got.get(tuple(parts), 0) + n
    assert got == {("a",): 3, ("b",): 2, ("c",): 2, ("x",): 1, ("a", "b"): 3, ("a", "b", "c"): 3, ("b", "c", "x"): 1}


def test_segmentation_is_least_cost():
    """The words that the paths agree on are taken at once; the result is that of trying every end."""
    rng = random.Random(3)
    some = lambda a, b: "".join(rng.choice("กขคา่เ.") for _ in range(rng.randint(a, b)))
    for _ in range(300):
        lex = tokenize.Lexicon({some(2, 6): rng.choice([60, 1000, 90000]) for _ in range(20)}, phrases=[some(3, 8)], extras=[some(1, 2)])
        for run in (some(1, 40) for _ in range(5)):
            best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
            for i in range(len(run)):
                ends = [(j, lex.cost[run[i:j]]) for j in range(i + 1, len(run) + 1) if run[i:j] in lex.cost]
                m = tokenize.CLUSTER.match(run, i)
                for j, c in ends or [(m.end() if m else i + 1, tokenize.UNKNOWN_COST)]:
                    if best[i] + c < best[j]:
                        best[j], back[j] = best[i] + c, i
            words, cost = lex._best(run)
            assert cost == best[-1] and "".join(words) == run and lex.segment(run) == words
            ends = set(itertools.accumulate(map(len, words)))
            at = len(run)
            while at and run[back[at] : at] in lex.cost:
                assert at in ends
                at = back[at]


def test_latin_and_abbreviations(spark):
    r = spark.createDataFrame([("รพ.สต. ก.ค.ศ. ส.อบจ. It's a well-known x2",), (None,)], "t string").select(tokenize.abbreviations(F.col("t")).alias("a"), tokenize.latin_tokens(F.col("t")).alias("l")).collect()
    assert r[0]["a"] == ["รพ.", "สต.", "ก.ค.ศ.", "อบจ."] and r[0]["l"] == ["it's", "well-known", "x2"] and r[1]["a"] is None


def test_search(spark):
    df = spark.createDataFrame([(1, "โชคดีคดี", "05"[:1] + "53"), (2, "โชคดี", "05"), (3, "คดีคดี", None)], "id int, text string, breaks string")
    rows = {r["id"]: (r["hits"], r["places"]) for r in search.hits(df, "คดี").collect()}
    assert rows[1] == ([5], [2, 5]) and rows[2] == ([], [2]) and rows[3] == ([0, 3], [0, 3])
    assert {tuple(r) for r in search.search(df, "ชค", "id").collect()} == {(1, 1, True), (2, 1, True)}
    marked = spark.range(1).select(search.highlight(F.lit("aaaa"), F.array(F.lit(0), F.lit(1)), 2).alias("s")).first()["s"]
    assert [tuple(x) for x in marked] == [(0, 3)]
    words = spark.createDataFrame([("ข",), ("เก",), ("ก",), ("ฮ",)], "w string")
    assert [r[0] for r in words.orderBy(search.thai_order(F.col("w"))).collect()] == ["ก", "เก", "ข", "ฮ"]
    assert [r["id"] for r in search.page(df.select("id"), [F.col("id")], 2, 2).collect()] == [3]


def test_incremental(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "id int, scraped_at string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d"), (4, None)], "id int, scraped_at string")
    assert {r["id"] for r in incremental.changed(new, old, ["id"]).collect()} == {2, 3}
    assert incremental.changed(new, old, ["id"], rebuild=True).count() == 4
    path = str(tmp_path / "t")
    incremental.replace(spark.createDataFrame([(1, 1), (2, 2)], "v int, m int"), path, ["m"])
    incremental.replace(spark.createDataFrame([(9, 2)], "v int, m int"), path, ["m"])
    assert {tuple(r) for r in spark.read.parquet(path).select("m", "v").collect()} == {(1, 1), (2, 9)}
    assert incremental.with_defaults(new, {"x": F.lit(0)}).columns == ["id", "scraped_at", "x"]


def _meeting(i, at, text):
    seg = {"id": f"{i}-1", "start": 0.0, "stop": 1.0, "speaker": "A", "speaker_party": None, "speaker_province": None, "text": text, "text_raw": text}
    return {"phase": "27", "meeting_id": str(i), "meeting_date": "2026-01-02", "scraped_at": at, "clips": [{"seq": 1, "url": "u", "start_time": "10:00:00", "segments": [seg]}]}


def test_sources_and_stream(spark, tmp_path):
    src = tmp_path / "data"
    src.mkdir()
    (src / "1.json").write_text(json.dumps(_meeting(1, "t1", "one")))
    (src / "bad.json").write_text("{ not json")
    m = meetings.meetings(spark, str(src))
    assert m.count() == 1 and meetings.segments(m).first()["text"] == "one" and meetings.clips(m).first()["tags"] == []
    (src / "bad.json").unlink()
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    ingest.run(spark, str(src), out, chk).awaitTermination()
    (src / "2.json").write_text(json.dumps(_meeting(1, "t2", "again")))
    (src / "3.json").write_text(json.dumps(_meeting(2, "t1", "two")))
    ingest.run(spark, str(src), out, chk).awaitTermination()
    assert {(str(r["meeting_id"]), r["text"]) for r in spark.read.parquet(out).collect()} == {("1", "again"), ("2", "two")}


def test_lists_and_roster(spark, tmp_path):
    (tmp_path / "w.txt").write_text("กข ค # note\n# only\n\nthai  pbs\n")
    assert {r[0] for r in meetings.word_list(spark, str(tmp_path / "w.txt")).collect()} == {"กขค", "thaipbs"}
    assert {r[0] for r in meetings.word_list(spark, str(tmp_path / "w.txt"), True).collect()} == {"กข ค", "thai pbs"}
    (tmp_path / "m.json").write_text(json.dumps({"members": [{"member_no": 1, "name": "x"}]}))
    assert meetings.roster(spark, str(tmp_path / "m.json"), least=1).count() == 1
    try:
        meetings.roster(spark, str(tmp_path / "m.json"))
        raise AssertionError("a short roster must be refused")
    except ValueError:
        pass
    assert meetings.tiles(spark, "2026-01-01", "2026-01-10").count() == 2


def test_intro_and_mining(spark):
    s = spark.createDataFrame([(1, None, "กระผม สมชาย สมาชิกสภาผู้แทนราษฎร จังหวัดตาก พรรคก้าวหน้า"), (2, None, "สมหญิง ส.ส. พรรคใหม่"), (2, None, "สมหญิง ส.ส. พรรคก้าวหน้า"), (3, 7, "สมาน ส.ส. พรรคใหม่")], "person_id int, party_id int, text string")
    p = spark.createDataFrame([(1, "สมชาย"), (2, "สมหญิง"), (3, "สมาน")], "person_id int, first_name string")
    parties = spark.createDataFrame([("ก้าวหน้า",), ("ใหม่",)], "party string")
    assert [tuple(r) for r in enrich.intro_fill(s, p, parties).collect()] == [(1, "ก้าวหน้า")]
    docs = spark.createDataFrame([(["ท่อง", "เที่ยว", "ดี"],)] * 5 + [(["รถ", "ไฟ"],)] * 12, "t array<string>")
    lex = spark.createDataFrame([("ท่องเที่ยว", "dictionary")], "word string, tier string")
    none = spark.createDataFrame([], "word string")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    mined = mining.mine(docs, "t", lex, none, known=words("รถ", "ไฟ"))
    assert {(r["word"], r["tier"], r["n"]) for r in mined.collect()} == {("ท่องเที่ยว", "dictionary", 5), ("รถไฟ", "corpus", 12)}
    every = lambda **k: {r["word"] for r in mining.mine(docs, "t", lex, none, **({"known": words("รถ", "ไฟ")} | k)).collect()}
    assert every(known=words("รถ")) == {"ท่องเที่ยว"} and every(known=words("รถ", "ไฟ", "รถไฟ")) == {"ท่องเที่ยว"}  # parts must be words, known phrases are none
    assert every(names=words("รถ", "ไฟ")) == {"ท่องเที่ยว"} and every(names=words("รถ")) == {"ท่องเที่ยว"}
    assert every(places=words("ท่อง")) == {"รถไฟ"} and every(titles=("ไฟ",)) == {"ท่องเที่ยว"} and every(names=words("ท่อง", "เที่ยว")) == {"รถไฟ"}
    assert every(letters="^[ก-ฮ]+$") == set() and every(vetoed_edges=("รถ",)) == {"ท่องเที่ยว"} and every(prefixes=("ท่อง",)) == {"ท่องเที่ยว", "รถไฟ"}
    longer = spark.createDataFrame([("ab", "corpus", 10), ("abc", "corpus", 10), ("bc", "corpus", 50)], "word string, tier string, n int")
    assert {w for w, _, _ in mining.prune(longer)} == {"abc", "bc"}


def test_pick_display(spark):
    f = spark.createDataFrame([(1, "นายก ข", 9), (1, "รศ. ก ข", 1), (1, "พันเอกกกก ขขข", 2), (2, "นางง จจ", 2), (2, "งง จจ", 2)], "k int, f string, n int")
    assert {tuple(r) for r in names_op.pick_display(f, "k", "f", "n").collect()} == {(1, "พันเอกกกก ขขข"), (2, "งง จจ")}


def _tables(spark, folder, **frames):
    for name, (rows, kind) in frames.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")


def test_clouds_leave_names_out(spark, tmp_path):
    """A person's own name, and for parties and meetings everyone's names, places and party names, are in no cloud."""
    from plenum.operators import clouds
    from plenum.plans.model import Model

    words = ["สมชาย", "ใจดี", "ตาก", "พรรคหนึ่ง", "ถนน", "สมหญิง"]
    people = [(1, "นายสมชาย ใจดี", "k", False, True), (2, "นางสมหญิง งาม", "l", False, True), (3, None, None, False, False)]
    _tables(
        spark, tmp_path,
        persons=(people, "id long, name string, name_key string, is_presiding boolean, is_mp boolean"),
        terms=([(i, w, False) for i, w in enumerate(words)], "id long, term string, is_stopword boolean"),
        member_terms=([(p, p, t, 9 if (p == 1) == (t != 5) else 3, 2) for p in (1, 2) for t in range(6)], "party_id long, person_id long, term_id long, count long, speeches long"),
        meeting_terms=([(m, t, 5) for m in (1, 2) for t in range(6) if m == 1 or t < 2], "meeting_id long, term_id long, count long"),
        speeches=([(1, "ตาก"), (2, None)], "id long, province string"),
    )
    m = Model(spark, str(tmp_path))
    parties = spark.createDataFrame([("หนึ่ง",)], "party string")
    seen = lambda df, e: {(r[e], words[r["term_id"]]) for r in df.collect()}
    person = seen(clouds.person_cloud(m, "frequent"), "person_id")
    assert {w for p, w in person if p == 1} == {"ตาก", "พรรคหนึ่ง", "ถนน", "สมหญิง"} and {w for p, w in person if p == 2} == set(words) - {"สมหญิง"}
    assert {w for _, w in seen(clouds.party_cloud(m, "frequent", parties), "party_id")} == {"ถนน"}
    assert {w for _, w in seen(clouds.party_cloud(m, "frequent"), "party_id")} == {"ถนน", "พรรคหนึ่ง"}
    assert {w for _, w in seen(clouds.meeting_cloud(m, "frequent", parties), "meeting_id")} == {"ถนน"}
    assert {w for _, w in seen(clouds.meeting_cloud(m, "distinctive"), "meeting_id")} == {"ถนน", "พรรคหนึ่ง"}


def test_roster_page(spark, tmp_path):
    from plenum.sources import meetings

    item = '<li class="tb_{0}"><p>เลขประจำตัวสมาชิก : {0}</p><h4 style="margin-top:8px;">นาย&nbsp;ก  ข</h4>{1}</li>'
    page = item.format(7, "<h4>พรรคหนึ่ง</h4><h4>สมาชิกสภาผู้แทนราษฎร จังหวัดตาก เขตเลือกตั้งที่ 2</h4>") + item.format(8, "<h4>สมาชิกสภาผู้แทนราษฎร แบบบัญชีรายชื่อ</h4><h4>อื่น</h4>") + '<li class="tb_x"><h4>ไม่มีเลข</h4></li>'
    (tmp_path / "page.html").write_text(page)
    got = sorted(tuple(r) for r in meetings.roster_page(spark, str(tmp_path / "page.html")).drop("seat").collect())
    assert got == [(7, "นาย ก ข", "หนึ่ง", False, "ตาก", 2), (8, "นาย ก ข", None, True, "แบบบัญชีรายชื่อ", None)]


def test_broken_files_are_listed(spark, tmp_path):
    from plenum.sources import meetings

    (tmp_path / "a.json").write_text('{"phase": "1", "meeting_id": "2", "meeting_date": "2026-01-01", "clips": []}')
    (tmp_path / "b.json").write_text('{"phase": ')
    assert meetings.meetings(spark, str(tmp_path)).count() == 1
    assert [r["file"].rsplit("/", 1)[1] for r in meetings.failures(spark, str(tmp_path)).collect()] == ["b.json"]


def test_unknown_clusters_and_latin_entries():
    """An unknown cluster stands only where no word begins; Latin entries of several words are read with or without blanks."""
    assert tokenize.Lexicon({}, extras=["ก"]).segment("กั้น") == ["ก", "ั้น"]
    lex = tokenize.Lexicon({"ผม": 900, "ครม": 60}, abbreviations=["ครม."], manual=["แลนด์"], latin=["Thai PBS", "GDP"])
    assert lex.tokens("ผม Thai  PBS thaipbs GDP Thai PBS2") == ["ผม", "thai pbs", "thai pbs", "gdp", "thai", "pbs2"]
    assert lex.segment("ครม.แลนด์ผม") == ["ครม.", "แลนด์", "ผม"] and lex.breaks("Thai PBS ครม.") == [0, 4, 5, 8, 9, 12, 13]
    assert not any(map(tokenize.is_word, ["ก", "ะกข", "กเ", "abc", "ก" * 26])) and tokenize.is_word("ณ") and tokenize.is_word("ก.ล.ต.")


def test_prune_and_listing_helpers(spark):
    from plenum.operators import mining, names, search

    mined = spark.createDataFrame([("กขค", "a", 100), ("กข", "a", 102), ("ขค", "a", 200), ("กขคง", "b", 97), ("ค", "c", 96)], "word string, tier string, n long")
    assert mining.prune(mined) == [("กขคง", "b", 97), ("กข", "a", 102), ("ขค", "a", 200)]
    t = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["b", "a"]), (3, None), (4, [])], "id int, t array<string>")
    assert [(r["id"], r["n"]) for r in search.phrase(t, "t", ["a", "b"]).collect()] == [(1, 2)]
    stored = spark.createDataFrame([(1, "นายก ขค"), (2, "พันเอกก ขค"), (3, None)], "id int, name string")
    picked = spark.createDataFrame([(1, "พันเอกก ขค"), (2, "พลเอกก ขค"), (3, "ก")], "id int, display string")
    assert sorted(tuple(r) for r in names.refresh_display(stored, picked, "id").collect()) == [(1, "พันเอกก ขค"), (2, "พันเอกก ขค"), (3, "ก")]


def _records(spark):
    head = "phase string, meeting_id string, meeting_title string, meeting_council string, meeting_episode string, meeting_group string, meeting_year string, meeting_number string, meeting_date string, order int"
    playlist = spark.createDataFrame([("1", "7", "ประชุม", "สภา", "สมัย", "26", "2", "5", "2026-03-15", 0), ("1", "7", "อื่น", None, None, None, None, None, None, 1)], head)
    kind = """phase string, meeting_id string, seq int, order int, _id string, start double, stop double, text string, speaker array<string>, speaker_party array<string>, speaker_province array<string>,
        start_time string, end_time string, video_path string, tag array<string>, all_speaker array<string>, all_speaker_party array<string>, all_speaker_province array<string>"""
    rows = [
        ("1", "7", 2, 0, "c", 0.0, 1.0, "สาม", ["ข"], [], None, "10:05:00", "10:10:00", "v", None, None, ["x"], None),
        ("1", "7", 1, 1, "b", 1.0, 2.0, "สอง<br/>บรรทัด", ["ข", "ค"], ["พ"], ["ตาก"], None, None, None, ["t2"], None, None, None),
        ("1", "7", 1, 0, "a", 0.0, 1.0, "&lt;b&gt;หนึ่ง&lt;/b&gt;", [], None, None, "10:00:00", "10:05:00", "u", ["t"], ["ก", "ข"], ["พ"], ["ตาก", "น่าน"]),
        ("1", "7", 1, 2, "d", 2.0, 3.0, None, ["ข"], None, None, None, None, None, None, None, None, None),
    ]
    return meetings.records(playlist, spark.createDataFrame(rows, kind), "http://x")


def test_records_and_transcript(spark, tmp_path):
    made = _records(spark)
    r = made.first()
    first, second = r["clips"]
    assert r["meeting_title"] == "ประชุม" and first["seq"] == 1 and first["url"] == "http://x/video/1/7/1" and first["start_time"] == "10:00:00" and first["tags"] == ["t"] and second["tags"] == []
    assert [tuple(x) for x in first["all_speakers"]] == [("ก", "พ", "ตาก")] and second["all_speakers"] == []
    assert [(s["id"], s["speaker"], s["speaker_party"], s["text"], s["text_raw"]) for s in first["segments"]] == [("a", None, None, "หนึ่ง", "&lt;b&gt;หนึ่ง&lt;/b&gt;"), ("b", "ข", "พ", "สอง\nบรรทัด", "สอง<br/>บรรทัด"), ("d", "ข", None, "", None)]
    lines = sinks.transcript(made).first()["text"].split("\n")
    assert lines == [
        "ประชุม (สภา)", "สมัย  ชุดที่ 26 ปีที่ 2 ครั้งที่ 5", "Date: 2026-03-15   Meeting ID: 1/7", "", "===== Clip 1  10:00:00-10:05:00  http://x/video/1/7/1", "", "[(ไม่ระบุผู้พูด)]", "หนึ่ง", "", "[ข — พ, ตาก]", "สอง", "บรรทัด", "",
        "===== Clip 2  10:05:00-10:10:00  http://x/video/1/7/2", "", "[ข]", "สาม", "", "",
    ]
    target = str(tmp_path / "out")
    sinks.write_meetings(made, target)
    again = made.unionByName(made.withColumn("meeting_id", F.lit("8"))).withColumn("meeting_title", F.lit("ใหม่"))
    title = lambda: {(r["meeting_id"], r["meeting_title"]) for r in spark.read.schema("phase string, meeting_id string, meeting_title string").json(target).collect()}
    sinks.write_meetings(again, target)
    assert title() == {("7", "ประชุม"), ("8", "ใหม่")}
    sinks.write_meetings(again.where("meeting_id = '7'"), target, force=True)
    assert title() == {("7", "ใหม่"), ("8", "ใหม่")}
    sinks.write_roster(spark.createDataFrame([(2, "ข"), (1, "ก")], "member_no int, name string"), str(tmp_path / "roster"), "s", "t")
    assert [r["member_no"] for r in meetings.roster(spark, str(tmp_path / "roster"), least=1).collect()] == [1, 2]


def test_colours_and_topics(spark, tmp_path):
    """Operators on small side tables: colours, topic labels, manual lists."""
    (tmp_path / "c.json").write_text('{"parties": {"ก": {"color": "#112233", "name_en": "A"}, "ข": {"color": null}}}')
    colours = meetings.party_colours(spark, str(tmp_path / "c.json")).select("party", "color")
    filled = enrich.fill_colours(spark.createDataFrame([("ก",), ("ค",)], "party string"), colours)
    assert sorted(tuple(r) for r in filled.collect()) == [("ก", "#112233"), ("ค", None)]
    assert [r["party"] for r in enrich.uncoloured(filled).collect()] == ["ค"]
    topics = spark.createDataFrame([(1, "น้ำ")], "topic_id int, topic string")
    labels = spark.createDataFrame([(1, "k1", "model", 0.5), (1, "gone", "manual", 1.0)], "topic_id int, speech_key string, source string, confidence double")
    got = stats.speech_topics(topics, labels, spark.createDataFrame([("k1", 3)], "speech_key string, speech_id int"))
    assert {(r["speech_key"], r["topic"], r["speech_id"]) for r in got.collect()} == {("k1", "น้ำ", 3), ("gone", "น้ำ", None)}
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    thai, latin = meetings.manual_words(words("ลุ้น", "Thai PBS"))
    assert [r[0] for r in thai.collect()] == ["ลุ้น"] and [r[0] for r in latin.collect()] == ["Thai PBS"]
    assert [r[0] for r in meetings.abbreviations(words("ครม.", "กม."), words("กม.")).collect()] == ["ครม."]


def test_sort_keys_and_tags(spark):
    keys = search.pushed([], "words", True)
    assert keys == [("words", False)]
    keys = search.pushed(search.pushed(search.pushed(keys, "name", False), "province", False), "day", True)
    assert keys == [("day", False), ("province", True), ("name", True)]
    assert search.pushed(keys, "day", True)[0] == ("day", True) and search.pushed(keys, "name", False) == [("name", True), ("day", False), ("province", True)]
    t = spark.createDataFrame([(1, None, 5), (2, "ก", None), (3, "", 9), (4, "ข", 9)], "id int, province string, words int")
    order = search.stacked([("words", False), ("province", True)], F.col("id"))
    assert [r["id"] for r in t.orderBy(*order).collect()] == [4, 3, 1, 2]
    tags = stats.party_tags(spark.createDataFrame([("ก้าว", "#ffffff", "a.png"), ("ข", "red", "b.png"), ("ค", None, None)], "party string, color string, logo string"), ["a.png"])
    assert sorted(tuple(r) for r in tags.collect()) == [("ก้าว", "--pc: #ffffff; --pf: #111111", "a.png", None), ("ข", "", None, "ข"), ("ค", "", None, "ค")]
    assert names_op.N.sort_name("ดร. พันเอก ว่าที่ นาย สมชาย") == "นาย สมชาย"
