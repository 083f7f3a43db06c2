"""Settings and errors of recognition."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import yaml

from glyphreel.functions import exprs as E

OPENAI, PADDLE = "openai_llm", "paddle_ocr"
#: Limits and defaults.
STRICT_ATTEMPTS, POLL_SECONDS, BODY_LIMIT, DETAIL = 5, 5.0, 8 << 20, 500
PADDLE_TIMEOUT, PADDLE_RETRIES, PADDLE_BACKOFF = 120, 2, 1.0
PADDLE_URL, PADDLE_MODEL = "https://paddleocr.aistudio-app.com/api/v2/ocr/jobs", "PP-OCRv6"
#: Fixed value: what a service is asked where the settings have no template of their own.
PROMPT = 'OCR only. Output exactly {expected_count} dialogue lines in top-to-bottom order. Insert a standalone line "0123456789" only between adjacent dialogue lines. Do not output a leading or trailing separator. Do not include JSON or explanation.'


class ConfigError(ValueError):
    pass


class StatusError(RuntimeError):
    def __init__(self, status: int, url: str, detail: str = ""):
        super().__init__(f"the service answered {status} at {url}: {detail}")
        self.status = status


class SchemaError(RuntimeError):
    """An answer that isn't of the agreed form; asking again won't help."""


class Cancelled(RuntimeError):
    pass


class StrictMismatch(RuntimeError):
    def __init__(self, sheet: str, expected: int, got: int, lines: list[str], attempts: int = STRICT_ATTEMPTS):
        super().__init__(f"{sheet}: {got} lines instead of {expected} in the last of {attempts} attempts")
        self.lines = lines


@dataclass(frozen=True)
class OpenAI:
    api_base: str = ""
    api_key: str = ""
    model: str = ""
    max_tokens: int = 8192
    timeout_seconds: int = 120
    max_retries: int = 2
    retry_backoff_seconds: float = 1.0
    prompt_template: str = ""


@dataclass(frozen=True)
class Paddle:
    api_url: str = PADDLE_URL
    token: str = ""
    model: str = PADDLE_MODEL


@dataclass(frozen=True)
class OcrConfig:
    provider: str
    max_concurrency: int = 4
    openai: OpenAI = field(default_factory=OpenAI)
    paddle: Paddle = field(default_factory=Paddle)


def _number(section: dict, key: str, default: float, kind: type = int) -> float:
    v = section.get(key)
    if v is None:
        return default
    if isinstance(v, bool) or not isinstance(v, int | float) or (kind is int and not isinstance(v, int)):
        raise ConfigError(f"{key} must be a number")
    return kind(v)


def load(path: str) -> OcrConfig:
    if not os.path.exists(path):
        raise ConfigError(f"no settings file at {path}")
    with open(path, encoding="utf-8") as f:
        try:
            doc = yaml.safe_load(f) or {}
        except yaml.YAMLError as e:
            raise ConfigError(f"{path} is not YAML: {e}") from e
    general, o, p = (doc.get(k) or {} for k in ("ocr", OPENAI, PADDLE))
    text = lambda s, k: str(s.get(k) or "").strip()
    base = OpenAI()
    openai = OpenAI(
        text(o, "api_base").rstrip("/"), text(o, "api_key"), text(o, "model"), _number(o, "max_tokens", base.max_tokens), _number(o, "timeout_seconds", base.timeout_seconds),
        _number(o, "max_retries", base.max_retries), _number(o, "retry_backoff_seconds", base.retry_backoff_seconds, float), str(o.get("prompt_template") or ""),
    )
    paddle = Paddle(text(p, "api_url").rstrip("/") or PADDLE_URL, text(p, "token"), text(p, "model") or PADDLE_MODEL)
    config = OcrConfig(text(general, "provider"), _number(general, "max_concurrency", 4), openai, paddle)
    wrong = [
        (config.max_concurrency <= 0, "ocr.max_concurrency: needs a positive number"),
        (config.provider not in (OPENAI, PADDLE), f"ocr.provider: needs {OPENAI} or {PADDLE}"),
        (config.provider == OPENAI and not (openai.api_base and openai.api_key and openai.model), "openai_llm: needs api_base, api_key and model"),
        (config.provider == OPENAI and openai.max_retries < 0, "openai_llm.max_retries: needs zero or more"),
        (config.provider == OPENAI and openai.retry_backoff_seconds < 0, "openai_llm.retry_backoff_seconds: needs zero or more"),
        (config.provider == OPENAI and openai.timeout_seconds <= 0, "openai_llm.timeout_seconds: needs a positive number"),
        (config.provider == OPENAI and openai.max_tokens <= 0, "openai_llm.max_tokens: needs a positive number"),
        (config.provider == PADDLE and not paddle.token, "paddle_ocr: needs a token"),
    ]
    for bad, message in wrong:
        if bad:
            raise ConfigError(message)
    return config


def prompt(template: str, expected: int) -> str:
    """{{ and }} stand for braces, {expected_count} for the number; any other brace is an error."""
    tokens = re.findall(E.TEMPLATE_TOKEN, template.strip() or PROMPT)
    if "{" in tokens or "}" in tokens:
        raise ConfigError("openai_llm.prompt_template: a brace is neither doubled nor part of {expected_count}")
    return "".join({"{expected_count}": str(expected), "{{": "{", "}}": "}"}.get(x, x) for x in tokens)
