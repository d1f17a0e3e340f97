"""Scripts to scenes, blocks and channels."""

from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.plans.scenes import blocks_of, channel_texts, clean_lines, near_headings, page_lines, scene_meta, split_scenes

PAGES = [
    ("s", 1, "prologue\n1 INT. KITCHEN - DAY 1\nAction line one.\n\n2 EXT. STREET - NIGHT 2\nRev. 03/04\nAction line two.\n3 EXT. /INT. CAR - NIGHT 3\nlast"),
    ("s", 2, "4 OMITTED 4\n5 INT/EXT. FOREST - DAY 5\n12b int. nothing\n\n"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "story_id string, page_no int, text string")


def test_markers_types_and_dense_index(spark):
    rows = split_scenes(page_lines(pages(spark))).orderBy("scene_idx").collect()
    assert [r.marker_type for r in rows] == ["INT.", "EXT.", "EXT/INT.", "OMITTED", "INT/EXT."]
    assert [r.scene_idx_non_omitted for r in rows] == [0, 1, 2, -1, 3]
    assert [r.heading for r in rows] == ["INT. KITCHEN - DAY", "EXT. STREET - NIGHT", "EXT/INT. CAR - NIGHT", "OMITTED 4", "INT/EXT. FOREST - DAY"]
    assert rows[0].lines == ["Action line one.", ""] and rows[1].lines == ["Action line two."]
    assert [(r.page_start, r.page_end) for r in rows] == [(1, 1), (1, 1), (1, 1), (2, 2), (2, 2)]
    assert rows[4].scene_label_int == 5


def test_meta_and_near_headings(spark):
    lines = page_lines(pages(spark))
    meta = scene_meta(split_scenes(lines)).first()
    assert (meta.scene_markers_total, meta.scene_markers_non_omitted) == (5, 4)
    assert [r.line for r in near_headings(lines).collect()] == ["12b int. nothing"]
    odd = spark.createDataFrame([("s", 1, 0, "12 The INT here")], "story_id string, page_no int, line_no int, line string")
    assert near_headings(odd).count() == 1


def test_label_suffix_and_trailing_number(spark):
    df = spark.createDataFrame([("13A INT. HALL - DAY 13A",), ("13A INT. HALL - DAY 13",), ("7. EXT FIELD",), ("12 INTO",)], "line string")
    out = df.select(T.heading_parts(F.col("line")).alias("h")).select("h.*", T.heading_text(F.col("h.kind"), F.col("h.rest"), F.col("h.label")).alias("text")).collect()
    assert [r.text for r in out] == ["INT. HALL - DAY 13A", "INT. HALL - DAY", "EXT. FIELD", "INT. O"]


def test_blocks_speakers_and_junk(spark):
    lines = ["Harry sets the diary down.", "", "GINNY", "The diary is back.", "(CONTINUED)", "", "HARRY (V.O.)", "still action", "CUT TO:"]
    df = spark.createDataFrame([("s", lines)], "story_id string, lines array<string>")
    assert df.select(blocks_of(clean_lines(F.col("lines"))).alias("b")).first().b == [["Harry sets the diary down."], ["GINNY", "The diary is back."], ["HARRY (V.O.)", "still action"]]
    r = channel_texts(df).first()
    assert r.action_text == "Harry sets the diary down.\nHARRY (V.O.) still action" and r.dialogue_text == "The diary is back."


def test_keys_differ_as_they_should(spark):
    df = spark.createDataFrame([("The  Mrs-Norris!",), ("my Tom's  Diary ",), ("the the book",), ("Crème brûlée",), ("",)], "n string")
    c = F.col("n")
    rows = df.select(T.mention_key(c).alias("m"), T.object_key(c).alias("o"), T.alias_key(c).alias("a"), T.chunk_key(c).alias("c")).collect()
    assert rows[0].m == "mrsnorris" and rows[0].c == "mrs-norris"
    assert (rows[1].m, rows[1].o, rows[1].a) == ("my tom's diary", "tom's diary", "my tom's diary")
    assert rows[2].a == "the book" and rows[3].a == "crème brûlée" and rows[4].o == ""


def test_empty_pages(spark):
    empty = spark.createDataFrame([], "story_id string, page_no int, text string")
    assert split_scenes(page_lines(empty)).count() == 0
    assert split_scenes(page_lines(spark.createDataFrame([("s", 1, None)], empty.schema))).count() == 0


def test_script_scenes_match_sql_on_odd_documents(spark, tmp_path):
    """Carriage returns, headings, headers and speakers within documents, empty and null texts, repeated and null numbers."""
    import duckdb

    from storyloom import oracles, queries

    texts = ["a\r\nb\rc\nd", "4 INT. HALL - DAY 4\ntext", "one\n\nBOB\nsaid\n\nlast", "Rev. 2\nHARRY POTTER\nCUT TO\nCONTINUED: x", "", "\n\n", "plain", "again", None, "no number"]
    rows = [(i if i < 7 else 6, t) for i, t in enumerate(texts[:-1])] + [(None, texts[-1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(oracles.oracle_sql()["script_scenes"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in queries.script_scenes(spark, str(tmp_path)).collect()) == want and len(want) == 27


def test_a_script_of_any_length_is_dealt_out_once(spark, monkeypatch):
    """Its lines go to their stretches once and alone, and scenes with their lines never."""
    from storyloom.plans import scenes

    made = []

    class Seen(scenes.Stretches):
        def __init__(self, df, *more):
            made.append(df.columns)
            super().__init__(df, *more)

    monkeypatch.setattr(scenes, "Stretches", Seen)
    lines = page_lines(pages(spark))
    spread = sorted(map(repr, split_scenes(lines, spread=True).collect()))
    assert [c for c in made[0] if not c.startswith("_")] == ["story_id", "page_no", "line_no", "line"] and made[0][4:] == ["_opens"] and len(made) == 1
    assert spread == sorted(map(repr, split_scenes(lines).collect())) and len(spread) == 5
