"""Cue files read from a folder: encodings, odd names, missing files."""

from cuelake.sources import subtitles

SRT = "1\n00:00:01,000 --> 00:00:02,000\n%s\n\n2\n00:00:03,000 --> 00:00:02,000\nno length\n\n"
ASS = "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 2,0:00:01.00,0:00:02.50,Main,Ann,0,0,0,,one, two\n"


def fill(folder):
    (folder / "deep er").mkdir()
    files = {
        "a.srt": (SRT % "plain").encode(), "deep er/b #1%20.SRT": ("\ufeff" + SRT % "naïve").encode(), "gbk.srt": (SRT % "中文字幕").encode("gbk"), "c.ASS": ASS.encode(),
        "empty.vtt": b"", "junk.srt": bytes(range(256)) * 20, "notes.txt": b"not cues", "多.srt": (SRT % "x").encode("utf-8"),
    }
    for name, content in files.items():
        (folder / name).write_bytes(content)
    return files


def test_all_files_of_a_folder(spark, tmp_path):
    files = fill(tmp_path)
    cues, tracks = subtitles.load_cue_files(spark, str(tmp_path))
    told = {r["path"]: (r["codec"], r["n_cues"], r["notice"]) for r in tracks.collect()}
    assert set(told) == set(files) - {"empty.vtt"}  # Spark lists no empty files
    assert told["a.srt"] == told["gbk.srt"] == told["deep er/b #1%20.SRT"] == told["多.srt"] == ("subrip", 1, None)
    assert told["c.ASS"] == ("ass", 1, None) and told["junk.srt"] == told["notes.txt"] == ("subrip", 0, "no cues")
    said = {r["path"]: (r["start_us"], r["end_us"], r["plain_text"]) for r in cues.collect()}
    assert said["gbk.srt"] == (1_000_000, 2_000_000, "中文字幕") and said["c.ASS"] == (1_000_000, 2_500_000, "one, two") and said["deep er/b #1%20.SRT"][2] == "naïve"
    assert {r["path"] for r in subtitles.read_cue_files(spark, f"file:{tmp_path}/", pattern="*.{srt,SRT}").collect()} == {f for f in files if f.lower().endswith(".srt")}
    assert told["gbk.srt"][2] is None


def test_wanted_files_and_missing_ones(spark, tmp_path):
    fill(tmp_path)
    wanted = spark.createDataFrame([("a.srt",), ("a.srt",), ("gone.ass",), ("empty.vtt",), (None,), ("deep er",), ("../a.srt",)], "path string")
    cues, tracks = subtitles.load_cue_files(spark, str(tmp_path), wanted)
    assert {r["path"]: (r["codec"], r["n_cues"], r["notice"]) for r in tracks.collect()} == {"a.srt": ("subrip", 1, None), "gone.ass": ("unknown", 0, "missing or empty"), "empty.vtt": ("unknown", 0, "missing or empty"), "deep er": ("unknown", 0, "missing or empty"), "../a.srt": ("unknown", 0, "missing or empty")}
    assert cues.count() == 1 and subtitles.load_cue_files(spark, str(tmp_path), wanted.limit(0))[1].count() == 0
    asked = wanted.withColumnRenamed("path", "target")
    got = subtitles.existing(spark, str(tmp_path), asked, "target")
    assert sorted((str(r["target"]), r["exists"]) for r in got.collect()) == [("../a.srt", False), ("None", False), ("a.srt", True), ("a.srt", True), ("deep er", False), ("empty.vtt", False), ("gone.ass", False)]


def test_listing_opens_no_file(spark, tmp_path):
    fill(tmp_path)
    plan = subtitles.existing(spark, str(tmp_path), spark.createDataFrame([("a.srt",)], "path string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0].split("Project")[-1]
