"""The two services. Each call is made inside a task; retries are made here and never by Spark."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable
from functools import lru_cache
from urllib.parse import quote

import requests

from glyphreel.ocr import config as C
from glyphreel.operators import text as X


@lru_cache(maxsize=8)
def session(timeout: int) -> requests.Session:
    """One connection pool for each timeout and worker."""
    return requests.Session()


def retryable(e: BaseException | None) -> bool:
    if isinstance(e, C.StatusError):
        return e.status == 429 or e.status >= 500
    return isinstance(e, requests.Timeout | TimeoutError) and not isinstance(e, C.Cancelled)


def with_retry(call: Callable[[], str], sheet: str, retries: int, backoff: float, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if attempt == retries or not retryable(e):
                raise RuntimeError(f"{sheet}: {e} (attempts: {attempt + 1})") from e
            if backoff > 0:
                sleep(backoff * 2**attempt)
    raise AssertionError


def body_of(r: requests.Response) -> bytes:
    got = bytearray()
    for part in r.iter_content(1 << 16):
        got += part
        if len(got) > C.BODY_LIMIT:
            raise C.SchemaError(f"an answer of more than {C.BODY_LIMIT} bytes")
    return bytes(got)


def check(r: requests.Response, raw: bytes, url: str) -> None:
    if r.status_code >= 400:
        raise C.StatusError(r.status_code, url, raw.decode("utf-8", "replace").strip(X.SPACE)[: C.DETAIL])


def ask_openai(c: C.OpenAI, png: bytes, expected: int) -> str:
    payload = {
        "model": c.model, "temperature": 0, "max_tokens": c.max_tokens,
        "messages": [{"role": "user", "content": [{"type": "text", "text": C.prompt(c.prompt_template, expected)}, {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(png).decode()}}]}],
    }
    url = f"{c.api_base}/chat/completions"
    with session(c.timeout_seconds).post(url, json=payload, headers={"Authorization": f"Bearer {c.api_key}"}, timeout=c.timeout_seconds, stream=True) as r:
        raw = body_of(r)
        check(r, raw, url)
    try:
        choices = json.loads(raw)["choices"]
        return X.envelope_text(X.content_text(choices[0]["message"].get("content")))
    except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
        raise C.SchemaError(f"an answer without choices: {e!r}") from e


def dump_line(stage: str, status: int, url: str, raw: bytes) -> str:
    record: dict = {"stage": stage, "status_code": status, "url": url}
    try:
        record["body"] = json.loads(raw)
    except ValueError:
        record["body_text"] = raw.decode("utf-8", "replace")
    return json.dumps(record, ensure_ascii=False, separators=(",", ":")) + "\n"


def jsonl_text(raw: str) -> str:
    """Text of a result file: recognised boxes of a line if it has some, else its layout's markdown."""
    out = ""
    for line in raw.split("\n"):
        if not line.strip(X.SPACE):
            continue
        result = json.loads(line).get("result") or {}
        if result.get("ocrResults"):
            page = X.page_text([r.get("prunedResult") or {} for r in result["ocrResults"]])
            out += ("\n" if out and page else "") + page
        else:
            for page in result.get("layoutParsingResults") or []:
                out += ("\n" if out else "") + X.markdown_plain((page.get("markdown") or {}).get("text") or "")
    return out


def ask_paddle(c: C.Paddle, name: str, png: bytes, dump: list[str], sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> str:
    """Submit, poll until done under one deadline, fetch."""
    http, head, end = session(C.PADDLE_TIMEOUT), {"Authorization": f"Bearer {c.token}"}, now() + C.PADDLE_TIMEOUT

    def left() -> float:
        if now() >= end:
            raise TimeoutError("deadline exceeded")
        return end - now()

    def get(stage: str, r: requests.Response, url: str) -> dict:
        with r:
            raw = body_of(r)
            dump.append(dump_line(stage, r.status_code, url, raw))
            check(r, raw, url)
        return (json.loads(raw) or {}).get("data") or {}

    options = json.dumps({"useDocOrientationClassify": False, "useDocUnwarping": False, "useTextlineOrientation": False})
    job = get("submit", http.post(c.api_url, headers=head, data={"model": c.model, "optionalPayload": options}, files={"file": (name, png)}, timeout=left(), stream=True), c.api_url).get("jobId")
    if not job:
        raise C.SchemaError("an answer without a job id")
    url = f"{c.api_url}/{quote(job, safe='')}"
    while True:
        data = get("poll", http.get(url, headers=head, timeout=left(), stream=True), url)
        state = data.get("state")
        if state in ("pending", "running"):
            sleep(min(C.POLL_SECONDS, left()))
        elif state == "failed":
            raise RuntimeError(f"the job failed: {data.get('errorMsg')}")
        elif state == "done":
            break
        else:
            raise C.SchemaError(f"an unknown state of the job: {state}")
    where = (data.get("resultUrl") or {}).get("jsonUrl")
    if not where:
        raise C.SchemaError("an answer without the address of its result")
    with http.get(where, timeout=left(), stream=True) as r:
        raw = body_of(r)
        dump += [dump_line("result", r.status_code, where, line) for line in raw.split(b"\n") if line.strip()]
        if r.status_code >= 400:
            raise C.StatusError(r.status_code, where)
    return jsonl_text(raw.decode("utf-8", "replace"))


Provider = Callable[[str, bytes, int, list[str]], str]


def provider(config: C.OcrConfig, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """(sheet, png, expected, dump) -> text, with the service's retries."""

    def openai(sheet: str, png: bytes, expected: int, dump: list[str]) -> str:
        return with_retry(lambda: ask_openai(config.openai, png, expected), sheet, config.openai.max_retries, config.openai.retry_backoff_seconds, sleep)

    def paddle(sheet: str, png: bytes, expected: int, dump: list[str]) -> str:
        return with_retry(lambda: ask_paddle(config.paddle, sheet, png, dump, sleep), sheet, C.PADDLE_RETRIES, C.PADDLE_BACKOFF, sleep)

    return {C.OPENAI: openai, C.PADDLE: paddle}[config.provider]
