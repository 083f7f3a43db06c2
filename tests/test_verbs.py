"""Files in, files out: the three verbs, the command line, recognition with a stand-in service."""

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
import requests
from pyspark.sql import functions as F

from glyphreel import cli
from glyphreel.codecs import pgs, pixels, png, vobsub
from glyphreel.functions import exprs as E
from glyphreel.ocr import client, runner
from glyphreel.ocr import config as C
from glyphreel.plans import verbs
from glyphreel.sinks import writers
from glyphreel.sources import files
from glyphreel.sources.files import InputError
from tests.test_codecs import frame_stream


def picture(path, w=12, h=8):
    img = np.zeros((h, w, 4), np.uint8)
    img[2:-2, 2:-2] = 255
    path.write_bytes(png.encode(img))


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in (1, 2):
        picture(src / f"{k}.png")
    (src / "notes.txt").write_text("x")
    return src


def test_parse_images(spark, folder, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "sheet_0009.png").write_bytes(b"old")
    (out / "keep.me").write_text("x")
    assert verbs.parse(spark, str(folder), str(out), limit=2).count == 1
    items = json.loads((out / "mapping.json").read_text())["items"]
    assert [tuple(i.values()) for i in items] == [(1, 0, 1000, "sheet_0001.png", 1), (2, 1000, 2000, "sheet_0001.png", 2)]
    srt = (out / "timeline.srt").read_text()
    assert srt.startswith("1\n00:00:00,000 --> 00:00:01,000\n[img:sheet_0001.png#01]\n\n2\n") and srt.endswith("#02]\n")
    assert not (out / "sheet_0009.png").exists() and (out / "keep.me").exists()
    # 8 x 4 after cropping, padded by 10: 24 high, and so is the digit row below each cue
    assert png.decode((out / "sheet_0001.png").read_bytes()).shape == (4 * 24, 28, 4)


@pytest.mark.parametrize(("names", "text"), [(["1.png", "3.png"], "missing 2"), (["1.png", "2.jpg"], "mixes"), (["1.png", "01.png"], "duplicate"), (["a.png"], "not a number")])
def test_bad_numbers(spark, tmp_path, names, text):
    for n in names:
        picture(tmp_path / n)
    with pytest.raises(InputError, match=text):
        verbs.parse(spark, str(tmp_path), str(tmp_path / "o"))


def test_export_pgs(spark, tmp_path):
    src = tmp_path / "film.sup"
    src.write_bytes(frame_stream())
    got = verbs.export(spark, str(src))
    assert got.count == 2 and got.output_dir == str(tmp_path / "film")
    assert sorted(p.name for p in (tmp_path / "film").iterdir() if not p.name.startswith(".")) == ["cue_00001.png", "cue_00002.png", "mapping.json", "timeline.srt"]
    items = json.loads((tmp_path / "film" / "mapping.json").read_text())["items"]
    assert [(i["start_ms"], i["end_ms"], i["sheet"], i["position_in_sheet"]) for i in items] == [(1000, 2000, "cue_00001.png", 1), (2000, 4000, "cue_00002.png", 1)]


def test_parse_vobsub(spark, tmp_path):
    px = np.random.default_rng(0).integers(0, 4, (6, 30), dtype=np.uint8)
    unit = vobsub.packets(vobsub.encode_unit(px, 5, 7, alphas=(0, 15, 15, 15)), 0x21)
    (tmp_path / "d.sub").write_bytes(unit + unit)
    (tmp_path / "d.idx").write_text(f"# x\npalette: 000000, ff0000, 00ff00, 0000ff\nlangidx: 1\ntimestamp: 00:00:03:000, filepos: {len(unit):09x}\ntimestamp: 00:00:01:000, filepos: 000000000\n")
    assert verbs.parse(spark, str(tmp_path / "d.idx"), layout="no-row-index").count == 1
    items = json.loads((tmp_path / "d" / "mapping.json").read_text())["items"]
    assert [(i["cue_index"], i["start_ms"], i["end_ms"]) for i in items] == [(1, 1000, 3000), (2, 3000, 5000)]
    (tmp_path / "d.sub").unlink()
    with pytest.raises(Exception, match="missing .sub"):
        verbs.parse(spark, str(tmp_path / "d.idx"))


def test_damaged_and_unknown_inputs(spark, tmp_path):
    (tmp_path / "a.sup").write_bytes(frame_stream()[:-1])
    with pytest.raises(Exception, match="truncated"):
        verbs.parse(spark, str(tmp_path / "a.sup"))
    (tmp_path / "a.mkv").write_bytes(b"")
    for path, text in (("a.mkv", "unsupported"), ("none.sup", "not found")):
        with pytest.raises(InputError, match=text):
            verbs.parse(spark, str(tmp_path / path))
    with pytest.raises(InputError, match="directory"):
        verbs.export(spark, str(tmp_path))


def test_command_line(spark, folder):
    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        return cli.execute(list(args), out, err, lambda: spark), out.getvalue(), err.getvalue()

    assert run()[0] == 0 and "Commands" in run("help")[1]
    assert run("what")[0] == 2
    for args, text in ((("parse",), "exactly one"), (("parse", "x", "--limit", "0"), "> 0"), (("parse", "x", "--limit", "a"), "integer"), (("parse", "x", "--layout", "q"), "one of"), (("export", "x", "--zap"), "unknown flag"), (("ocr", "x", "--config"), "needs an argument"), (("parse", "x", "--padding", "-1"), ">= 0")):
        code, _, err = run(*args)
        assert code == 1 and text in err
    code, out, _ = run("parse", str(folder), "--limit", "1", "--force-white")
    assert code == 0 and out == f"Generated 2 sheets in {folder}_out\n"
    assert "--strict" in run("ocr", "x", "--help")[1]
    assert cli.progress_line("load", 1, 2) == "\rload             [############------------]  50% (1/2)" and "(0/0)" in cli.progress_line("x", 5, 0)


CONFIG = """
ocr: {{provider: {provider}, max_concurrency: 2}}
openai_llm: {{api_base: "{url}/v1/", api_key: k, model: m, max_retries: 1, retry_backoff_seconds: 0, prompt_template: ""}}
paddle_ocr: {{api_url: "{url}/jobs", token: t}}
"""


@pytest.fixture
def sheets(tmp_path):
    out = tmp_path / "sheets"
    out.mkdir()
    items = [(1, "a.png", 1), (2, "a.png", 2), (3, "b.png", 1)]
    (out / "mapping.json").write_text(json.dumps({"items": [{"cue_index": i, "start_ms": i * 1000, "end_ms": i * 1000 + 500, "sheet": s, "position_in_sheet": p} for i, s, p in items]}))
    picture(out / "a.png")
    picture(out / "b.png", 20)
    return out


def texts(path):
    return [b.split("\n", 2)[2].strip("\n") for b in path.read_text().rstrip("\n").split("\n\n")]


def run_with(spark, sheets, answers, tmp_path, strict=False):
    """answers: sheet -> list of texts, the last of which repeats. Counts of calls are kept in files, as tasks are other processes."""
    cfg = tmp_path / "c.yaml"
    cfg.write_text(CONFIG.format(provider="openai_llm", url="http://x"))

    def make(_):
        def ask(sheet, data, expected, dump):
            log = tmp_path / f"{sheet}.calls"
            n = len(log.read_text()) if log.exists() else 0
            log.write_text("x" * (n + 1))
            return answers[sheet][min(n, len(answers[sheet]) - 1)]

        return ask

    return runner.run_folder(spark, str(sheets), str(cfg), strict, make=make)


def test_recognition(spark, sheets, tmp_path):
    run_with(spark, sheets, {"a.png": ["line a 0123456789 line b"], "b.png": ["line c"]}, tmp_path)
    assert texts(sheets / "timeline.srt") == ["line a", "line b", "line c"]
    run_with(spark, sheets, {"a.png": ["only"], "b.png": ["0123456789"]}, tmp_path)
    assert texts(sheets / "timeline.srt") == ["only", "[img:a.png#02]", "[img:b.png#01]"]


def test_strict(spark, sheets, tmp_path):
    run_with(spark, sheets, {"a.png": ["x", "x", "p 0123456789 q"], "b.png": ["c"]}, tmp_path, strict=True)
    assert texts(sheets / "timeline.srt") == ["p", "q", "c"] and (tmp_path / "a.png.calls").read_text() == "xxx"
    (tmp_path / "a.png.calls").unlink()
    with pytest.raises(RuntimeError, match=r"a\.png: 1 lines instead of 2 in the last of 5 attempts"):
        run_with(spark, sheets, {"a.png": ["x"], "b.png": ["c"]}, tmp_path, strict=True)
    assert texts(sheets / "timeline.srt") == ["x", "[img:a.png#02]", "c"]


def test_recognition_errors(spark, sheets, tmp_path):
    (sheets / "b.png").unlink()
    with pytest.raises(RuntimeError, match=r"no image of b\.png"):
        run_with(spark, sheets, {"a.png": ["x"]}, tmp_path)
    assert not (sheets / "timeline.srt").exists()
    (sheets / "mapping.json").write_text('{"items": []}')
    with pytest.raises(InputError, match="no items"):
        run_with(spark, sheets, {}, tmp_path)
    (sheets / "mapping.json").unlink()
    with pytest.raises(InputError, match="not found"):
        run_with(spark, sheets, {}, tmp_path)


@pytest.fixture
def service():
    class Handler(BaseHTTPRequestHandler):
        seen: list = []
        polls = 0

        def answer(self, body, status=200):
            raw = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_POST(self):
            data = self.rfile.read(int(self.headers["Content-Length"]))
            Handler.seen.append((self.path, self.headers["Authorization"], data))
            if self.path == "/v1/chat/completions":
                if len([s for s in Handler.seen if s[0] == self.path]) == 1:
                    return self.answer(b"busy", 503)
                return self.answer({"choices": [{"message": {"content": '```json\n{"text": "one 0123456789 two"}\n```'}}]})
            return self.answer({"data": {"jobId": "j/1"}})

        def do_GET(self):
            if self.path.startswith("/jobs/"):
                Handler.polls += 1
                done = Handler.polls % 2 == 0
                return self.answer({"data": {"state": "done" if done else "running", "resultUrl": {"jsonUrl": f"http://127.0.0.1:{self.server.server_port}/r.jsonl"}}})
            boxes = {"result": {"ocrResults": [{"prunedResult": {"rec_texts": ["A", "B"], "rec_boxes": [[0, 0, 9, 9], [0, 50, 9, 60]]}}]}}
            layout = {"result": {"layoutParsingResults": [{"markdown": {"text": "<p>C &amp; D</p>"}}]}}
            return self.answer((json.dumps(boxes) + "\n\n" + json.dumps(layout)).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", Handler
    server.shutdown()


def test_services(service, tmp_path):
    url, handler = service
    path = tmp_path / "c.yaml"
    path.write_text(CONFIG.format(provider="openai_llm", url=url))
    assert client.provider(C.load(str(path)), lambda _: None)("a.png", b"png", 2, []) == "one 0123456789 two"
    sent = json.loads(handler.seen[-1][2])
    assert sent["temperature"] == 0 and "exactly 2 dialogue lines" in sent["messages"][0]["content"][0]["text"] and handler.seen[-1][1] == "Bearer k"
    path.write_text(CONFIG.format(provider="paddle_ocr", url=url))
    dump = []
    assert client.provider(C.load(str(path)), lambda _: None)("a.png", b"png", 2, dump) == "A\n\nB\nC & D"
    assert [json.loads(d)["stage"] for d in dump] == ["submit", "poll", "poll", "result", "result"]


@pytest.mark.parametrize(("error", "want"), [(requests.Timeout(), True), (TimeoutError(), True), (C.StatusError(429, ""), True), (C.StatusError(503, ""), True), (C.StatusError(400, ""), False), (C.StatusError(401, ""), False), (C.SchemaError("x"), False), (C.Cancelled(), False), (requests.ConnectionError(), False), (None, False)])
def test_retryable(error, want):
    assert client.retryable(error) is want


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    for text, message in (("ocr: {provider: x}", "provider"), ("ocr: {provider: openai_llm}", "needs api_base"), ("ocr: {provider: paddle_ocr}", "needs a token"), ("ocr: {provider: paddle_ocr, max_concurrency: 0}", "max_concurrency"), ("ocr: [", "not YAML")):
        path.write_text(text)
        with pytest.raises(C.ConfigError, match=message):
            C.load(str(path))
    with pytest.raises(C.ConfigError, match="no settings file"):
        C.load(str(tmp_path / "none"))


def test_prompts(spark):
    fine = {"{{a}} {expected_count}": "{a} 3", "{{{expected_count}": "{3", "{{expected_count}}": "{expected_count}", "}}{{": "}{", "{expected_count}{expected_count}": "33", "plain": "plain"}
    for template, shown in fine.items():
        assert C.prompt(template, 3) == shown
        assert spark.range(1).select(E.render_template(F.lit(template), F.lit(3))).first()[0] == shown
    assert C.prompt("", 4) == C.PROMPT.replace("{expected_count}", "4")
    for template in ("{oops}", "{", "a}", "{expected_count}}", "{expected_count}}}", "{{{"):
        with pytest.raises(C.ConfigError):
            C.prompt(template, 1)
        with pytest.raises(Exception, match="brace"):
            spark.range(1).select(E.render_template(F.lit(template), F.lit(3))).first()


def test_first_error_ends_asking(spark, tmp_path):
    stop = str(tmp_path / "stop")
    asked = tmp_path / "asked"

    def make():
        def ask(sheet, png, expected, dump):
            with open(asked, "a") as f:
                f.write(sheet + "\n")
            if sheet == "s05":
                raise RuntimeError("down")
            return "x"

        return ask

    sheets = spark.createDataFrame([(f"s{i:02}", b"p", 1) for i in range(40)], "sheet string, png binary, expected int").coalesce(1)
    rows = runner.recognise(sheets, make, 1, stop=stop).toPandas()
    n = len(asked.read_text().split())
    assert (rows.error_kind == "error").sum() == 1 and (rows.error_kind == "skipped").sum() == 40 - n and rows[rows.error_kind == "error"].error.item() == "down"


def test_files_of_other_verbs_do_not_count(spark, tmp_path):
    (tmp_path / "cue_00001.png").write_bytes(b"old")
    df = spark.createDataFrame([("a.png", b"1"), ("b.png", b"2")], "name string, png binary")
    assert writers.write_binaries(df, str(tmp_path), "name", "png") == 2 and (tmp_path / "b.png").read_bytes() == b"2"


def test_suffixes_of_any_case(spark, tmp_path):
    for name in ("1.Png", "2.pNG", "3.png", "4.txt"):
        (tmp_path / name).write_bytes(b"x")
    images = files.numbered_images(spark, str(tmp_path))
    files.check_numbers(images)
    assert sorted(r.cue_index for r in images.collect()) == [1, 2, 3]


def test_streaming(spark, tmp_path):
    from glyphreel.operators import frames
    from glyphreel.streaming import watch

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.sup").write_bytes(frame_stream())
    (src / "b.sup").write_bytes(b"nonsense")
    q = watch.watch_pgs(spark, str(src)).writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.frame_no, r.error is None) for r in spark.table("shown").collect()) == [(0, False), (1, True), (2, True)]
    files = spark.createDataFrame([("a", bytearray(frame_stream()))], "stream_id string, content binary")
    segments = frames.pgs_segments(files)
    assert [r.frame_no for r in frames.fold_segments(segments).orderBy("frame_no").collect()] == [1, 2]
    for part, where in (("p1", "seg_no < 3"), ("p2", "seg_no >= 3")):
        segments.where(where).write.parquet(str(tmp_path / "seg" / part))
    read = spark.readStream.schema(segments.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "seg" / "*"))
    q = watch.fold_stream(read).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.frame_no for r in spark.table("folded").collect()) == [1, 2]


def test_preprocess_wrap():
    img = np.zeros((3, 3, 4), np.uint8)
    img[1, 1] = (255, 10, 0, 128)
    want = pixels.premultiply(np.array([[[253, 19, 0, 128]]], np.uint8))
    assert pixels.preprocess(img, padding=0)[0, 0].tolist() == want[0, 0].tolist()
    assert pgs.ticks_to_ms(45) == 1
