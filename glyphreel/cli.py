"""Command line: parse, export, ocr."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any, TextIO

USAGE = """glyphreel: bitmap subtitles on Spark

Usage:
  glyphreel <command> [args]

Commands:
  parse    input -> sheets, timeline.srt, mapping.json
  export   input -> one image for each cue, timeline.srt, mapping.json
  ocr      sheets and mapping.json -> timeline.srt with text
"""
HELP = {
    "parse": """Usage:
  glyphreel parse <input.sup|input.idx|image_dir> [options]

Options:
  -o, --output <dir>   output folder (default: beside the input)
  --limit <n>          cues on a sheet at most (6)
  --layout <mode>      digits (default) or no-row-index
  --max-width <n>      width of a cue at most (1080)
  --padding <n>        transparent border of a cue (10)
  --force-white        white foreground
""",
    "export": """Usage:
  glyphreel export <input.sup|input.idx> [-o <dir>]
""",
    "ocr": """Usage:
  glyphreel ocr <output_dir> [options]

Options:
  --config <file>                settings (ocr_config.yaml)
  --strict                       lines must be as many as cues
  --dump-paddle-responses <dir>  keep responses, a JSON Lines file for each sheet
""",
}
#: flag -> (option, kind); kind None takes no value
FLAGS: dict[str, dict[str, tuple[str, Any]]] = {
    "parse": {"-o": ("output", str), "--output": ("output", str), "--limit": ("limit", int), "--layout": ("layout", str), "--max-width": ("max_width", int), "--padding": ("padding", int), "--force-white": ("force_white", None)},
    "export": {"-o": ("output", str), "--output": ("output", str)},
    "ocr": {"--config": ("config_path", str), "--strict": ("strict", None), "--dump-paddle-responses": ("dump_dir", str)},
}


class UsageError(ValueError):
    pass


def read_args(command: str, args: list[str]) -> tuple[str, dict[str, Any]]:
    options: dict[str, Any] = {}
    inputs, rest = [], list(args)
    while rest:
        arg = rest.pop(0)
        if not arg.startswith("-") or arg == "-":
            inputs.append(arg)
            continue
        flag, eq, value = arg.partition("=")
        if flag not in FLAGS[command]:
            raise UsageError(f"failed to parse {command} flags: unknown flag: {arg}")
        name, kind = FLAGS[command][flag]
        if kind is None:
            options[name] = True
            continue
        if not eq and not rest:
            raise UsageError(f"failed to parse {command} flags: flag needs an argument: {flag}")
        value = value if eq else rest.pop(0)
        try:
            options[name] = kind(value)
        except ValueError:
            raise UsageError(f"{flag} must be an integer") from None
    if len(inputs) != 1:
        raise UsageError(f"{command} requires exactly one {'output directory' if command == 'ocr' else 'input path'}")
    for name, ok, text in (("limit", lambda v: v > 0, "--limit must be > 0"), ("max_width", lambda v: v > 0, "--max-width must be > 0"), ("padding", lambda v: v >= 0, "--padding must be >= 0"), ("layout", lambda v: v in ("digits", "no-row-index"), "--layout must be one of: digits, no-row-index")):
        if name in options and not ok(options[name]):
            raise UsageError(text)
    return inputs[0], options


def progress_line(stage: str, done: int, total: int, width: int = 24) -> str:
    total, done = max(total, 0), max(0, min(done, max(total, 0)))
    share = done / total if total else 0.0
    full = int(share * width)
    return f"\r{stage:<16} [{'#' * full}{'-' * (width - full)}] {share * 100:3.0f}% ({done}/{total})"


def execute(args: list[str], out: TextIO = sys.stdout, err: TextIO = sys.stderr, session: Callable[[], Any] | None = None) -> int:
    """Exit status: 0 done or help, 1 failed, 2 unknown command."""
    if not args or args[0] in ("-h", "--help", "help"):
        out.write(USAGE)
        return 0
    command, rest = args[0], args[1:]
    if command not in FLAGS:
        err.write(f"unknown command: {command}\n\n{USAGE}")
        return 2
    if "-h" in rest or "--help" in rest:
        out.write(HELP[command])
        return 0
    line_open = False

    def progress(stage: str, done: int, total: int) -> None:
        nonlocal line_open
        line_open = done < total
        err.write(progress_line(stage, done, total) + ("" if line_open else "\n"))

    try:
        path, options = read_args(command, rest)
        if session is None:
            from pyspark.sql import SparkSession

            session = SparkSession.builder.appName("glyphreel").config("spark.sql.session.timeZone", "UTC").getOrCreate
        spark = session()
        if command == "ocr":
            from glyphreel.ocr import runner

            where = runner.run_folder(spark, path, options.pop("config_path", "ocr_config.yaml"), progress=lambda d, t: progress("ocr", d, t), **options)
            out.write(f"OCR timeline written to: {where}\n")
        else:
            from glyphreel.plans import verbs

            got = getattr(verbs, command)(spark, path, progress=progress, **options)
            out.write(f"Generated {got.count} sheets in {got.output_dir}\n" if command == "parse" else f"Exported {got.count} cue images in {got.output_dir}\n")
    except Exception as e:  # noqa: BLE001
        err.write(("\n" if line_open else "") + f'command "{command}" failed: {e}\n')
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(execute(sys.argv[1:]))
