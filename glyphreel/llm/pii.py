"""Personal data: four base patterns and a linear-chain conditional random field that adds what they miss.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and without overlap within a kind. The field
labels word, number and sign tokens with B/I tags of the kinds; its features are word shapes and a few words nearby.
It is trained here from a small labelled table (TRAINING) by gradient ascent on the log likelihood and decoded by
Viterbi over numpy batches. A text is cut for it into stretches around digits, @, bracketed at/dot and words
like "a at b dot c", in any case; other ways of writing an address are not looked at. A span that it adds must hold the digits or parts of its kind and must not
overlap a base span.

Cases: a null text is read as empty and has no span; n_* and base_sha256 describe base spans only, `spans` holds all.
Repeated rows get equal results; an empty table gives no rows; extra columns aren't read. Tags that score alike are tied
by their order in TAGS. Offsets are code points, end exclusive. Spans may have any length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from glyphreel.llm.common import map_text, replace_text, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A start within a run of digits fails like the run's first digit, so only that one is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small_parts(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """In the order of start, then kind."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if small_parts(m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((*m.span(), "phone"))
        found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# The field.
TAGS = ("O", *(f"{bi}-{k}" for k in KINDS for bi in "BI"))
N = len(TAGS)
DIM = 1 << 12
CLUES = frozenset("at dot email mail tel phone call fax mobile card visa pay ip host server from com org net".split())
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s\w]|_")
_TRIGGER = re.compile(r"[0-9@]+|[(\[{<]\s*(?:at|dot)\s*[)\]}>]|\bat\s+[\w-]+(?:\s*\.\s*[\w-]+)*\s+dot\s", re.I)
REACH = 48

#: The small labelled table: a text with [kind ...] around each item.
TRAINING = tuple(
    """write to [email anna.berg (at) example (dot) com] today
mail me at [email tom [at] mail.example.org] please
contact [email lee (at) sample (dot) net] or come by
mail [email bob (at) site (dot) org] ok
ask [email mia.k [at] firm [dot] example [dot] net] first
or [email joe99 (at) post (dot) de] later
send it to [email info <at> example <dot> de] now
reach [email r.diaz @ example . com] soon
ask [email anna (AT) example (DOT) com] today
write to [email KIM.LEE [At] Mail [Dot] Sample [Dot] ORG] please
mail [email anna at example dot com] now
please ask [email bob at sample dot com] today
just tell [email eva at firm dot net] that we know
send it to [email lee.k at post dot example dot net] today
reach [email Tom at site dot org] or come by
we met at noon and left on the dot of nine
look at this dot on the map
he was at home dot and all
call [phone (212) 555-0143] before noon
phone: [phone 415-555-0199] ask for Sam
tel [phone 030 5550 1234] in the morning
my number is [phone 646.555.0172] thanks
fax [phone (0)20 7946 0958] office
mobile [phone 0170 555 01234] anytime
card [card 4111.1111.1111.1111] expires soon
pay with [card 5500_0000_0000_0004] today
visa [card 4012/8888/8888/1881] on file
host [ip 192 . 168 . 0 . 12] is down
server [ip 10[.]20[.]30[.]40] replied
ip [ip 172(.)16(.)254(.)1] blocked
the year 1998 was better than 2003
order 4839201 shipped on 12/05/2021
see pages 12-48 and table 3.1
version 2.4.10 was released in 2019
total 1,234.56 or 99.90 each
token = 269b1cea0846965f2d3ecb5cdb87c0edc7a7a587 was found
invoice 20210412-7781 is paid
room 204, floor 2, at 10:30
section 4.2.1 of the report at hand
born 1984-03-12 in the dot of winter
score 3-2 after 90 minutes
meet at 5 in the hall
id 9807915762804490 raie esllra
the ratio 16:9 and 4:3 at most
isbn 978-3-16-148410-0 in print
step 1 . step 2 . step 3 . step 4
1 2 3 4 5 6 7 8 9 10 11 12
(3) items at (4) places @ once
@ home or @ work 24 hours
in 2020 , 2021 and 2022 the rates were 3 4 and 5
plain words only and nothing else here
part 555-01 costs 20 at least""".split("\n")
)


def tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]


def shape(token: str) -> str:
    c = token[0]
    if c.isdecimal() and c.isascii():
        return "d" * len(token) if len(token) < 6 else "d+"
    if c.isalpha():
        return ("X" if c.isupper() else "x") + ("x" if len(token) > 1 else "")
    return c


@lru_cache(maxsize=200_000)
def _feature(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % DIM


WIDTH = 11


def features(words: list[tuple[int, int, str]]) -> np.ndarray:
    """Feature numbers, WIDTH for a token."""
    shapes = ["^", "^", *(shape(w) for _, _, w in words), "$", "$"]
    clue = ["", "", *((w.lower() if w.lower() in CLUES else "") for _, _, w in words), "", ""]
    out = np.empty((len(words), WIDTH), np.int64)
    for i in range(len(words)):
        a, b, c, d, e = shapes[i : i + 5]
        gap = str(int(i > 0 and words[i][0] > words[i - 1][1]))
        out[i] = [_feature(x) for x in ("0" + c, "-" + b + "|" + c, "+" + c + "|" + d, "--" + a + b + c, "++" + c + d + e, "=" + b + c + d, "c0" + clue[i + 2], "c-" + clue[i + 1] + c, "c+" + clue[i + 3] + c, "g" + gap + b + c, "cc" + clue[i] + c)]
    return out


def labelled(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(email|ip|card|phone) ((?:\[[^\]]*\]|[^\]])*)\]", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(r) for r in rows)
    out, mask = np.zeros((len(rows), n, WIDTH), np.int64), np.zeros((len(rows), n), bool)
    for i, r in enumerate(rows):
        out[i, : len(r)], mask[i, : len(r)] = r, True
    return out, mask


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


#: Impossible steps: I of a kind after anything but B or I of it.
BARRED = np.array([[-1e4 if b.startswith("I-") and a[2:] != b[2:] else 0.0 for b in TAGS] for a in TAGS])
START = np.array([-1e4 if t.startswith("I-") else 0.0 for t in TAGS])


@lru_cache(maxsize=1)
def train(rounds: int = 120, rate: float = 0.08, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission and step weights, by Adam on the penalised log likelihood of the labelled table."""
    rows, gold = [], []
    for line in TRAINING:
        text, spans = labelled(line)
        ws = tokens(text)
        tag = np.zeros(len(ws), int)
        for a, b, k in spans:
            inside = [i for i, w in enumerate(ws) if a <= w[0] < b]
            for j, i in enumerate(inside):
                tag[i] = TAGS.index(("B-" if j == 0 else "I-") + k)
        rows.append(features(ws))
        gold.append(tag)
    x, mask = pad(rows)
    b, n = mask.shape
    y = np.zeros((b, n), int)
    for i, g in enumerate(gold):
        y[i, : len(g)] = g
    emit, step = np.zeros((DIM, N)), np.zeros((N, N))
    state = [np.zeros_like(v) for v in (emit, emit, step, step)]
    hot = np.eye(N)[y] * mask[..., None]
    for r in range(1, rounds + 1):
        s, move = emit[x].sum(2), step + BARRED
        forward, backward = np.zeros((b, n, N)), np.zeros((b, n, N))
        forward[:, 0] = s[:, 0] + START
        for t in range(1, n):
            forward[:, t] = np.where(mask[:, t, None], _lse(forward[:, t - 1, :, None] + move, 1) + s[:, t], forward[:, t - 1])
        for t in range(n - 2, -1, -1):
            backward[:, t] = np.where(mask[:, t + 1, None], _lse(move + (s[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0.0)
        z = _lse(forward[:, -1], 1)
        own = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        g_emit, g_step = -decay * emit, -decay * step
        np.add.at(g_emit, x, (hot - own)[:, :, None, :])
        for t in range(1, n):
            both = np.exp(forward[:, t - 1, :, None] + move + (s[:, t] + backward[:, t])[:, None, :] - z[:, None, None]) * mask[:, t, None, None]
            g_step += np.einsum("bi,bj->ij", hot[:, t - 1], hot[:, t]) - both.sum(0)
        for k, (w, g) in enumerate(((emit, g_emit), (step, g_step))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return emit, step + BARRED


def viterbi(rows: list[np.ndarray], emit: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
    """Best tags of each row; rows of like length share a batch."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
    while order:
        take, width = [], 0
        while order and (not take or len(take) < 256 and (len(take) + 1) * len(rows[order[-1]] if not take else rows[take[0]]) <= 20_000):
            take.append(order.pop())
        x, mask = pad([rows[i] for i in take])
        s = emit[x].sum(2)
        b, n = mask.shape
        best, back = s[:, 0] + START, np.zeros((n, b, N), np.int8)
        for t in range(1, n):
            c = best[:, :, None] + step
            back[t] = c.argmax(1)
            best = np.where(mask[:, t, None], c.max(1) + s[:, t], best)
        tag = best.argmax(1)
        tags = np.zeros((b, n), int)
        for t in range(n - 1, -1, -1):
            tags[:, t] = np.where(mask[:, t], tag, 0)
            tag = np.where(mask[:, t], back[t][np.arange(b), tag], tag) if t else tag
        for j, i in enumerate(take):
            out[i] = tags[j, : len(rows[i])]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around triggers, widened by REACH characters and then to white space."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    for s in out:
        while s[0] > 0 and not text[s[0] - 1].isspace() and s[0] > 0:
            s[0] -= 1
        while s[1] < len(text) and not text[s[1]].isspace():
            s[1] += 1
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def plausible(part: str, kind: str) -> bool:
    digits = _NOT_DIGIT.sub("", part)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and len(part) <= 2 * len(digits) + 2
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and len(part) <= 2 * len(digits) + 2
    if kind == "ip":
        return small_parts(re.findall(r"[0-9]+", part))
    return bool(re.search(r"[\w.%+-]\s*(@|[(\[{<]\s*at\s*[)\]}>]|\sat\s)\s*\w.*?(\.|dot)\s*.?\s*[A-Za-z]{2}", part, re.S | re.I))


def field_spans(texts: list[str], based: list[list[Span]]) -> list[list[Span]]:
    """What the field adds to the base spans of each text."""
    emit, step = train()
    jobs, rows = [], []
    for i, text in enumerate(texts):
        for a, b in stretches(text):
            ws = tokens(text[a:b])
            if ws:
                jobs.append((i, a, ws))
                rows.append(features(ws))
    out: list[list[Span]] = [[] for _ in texts]
    for (i, a, ws), tags in zip(jobs, viterbi(rows, emit, step), strict=True):
        if not tags.any():
            continue
        j = 0
        while j < len(ws):
            if TAGS[tags[j]].startswith("B-"):
                kind, k = TAGS[tags[j]][2:], j + 1
                while k < len(ws) and TAGS[tags[k]] == "I-" + kind:
                    k += 1
                start, end = a + ws[j][0], a + ws[k - 1][1]
                if plausible(texts[i][start:end], kind) and not any(s < end and start < e for s, e, _ in based[i]):
                    out[i].append((start, end, kind))
                j = k
            else:
                j += 1
    return out


def spans_of(texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """Of each text base spans, and all spans, in the order of start, then kind; the texts share the field's batches."""
    based = [base_spans(t) if t else [] for t in texts]
    looked = [i for i, t in enumerate(texts) if t and _TRIGGER.search(t)]
    out = [(b, b) for b in based]
    for i, more in zip(looked, field_spans([texts[i] for i in looked], [based[i] for i in looked]), strict=True):
        out[i] = based[i], sorted(based[i] + more, key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    return spans_of([text])[0]


def find_documents(docs: DataFrame, keys: list[str]) -> DataFrame:
    def make() -> Callable:
        train()

        def rows(texts):
            return [(*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)) for base, spans in spans_of(texts)]

        return rows

    return map_text(docs, keys, "text", make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", many=True)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_documents(table(spark, sf_dir, "documents"), ["doc_id"])


def _kind_sql(kind: str, pattern: str, good: str) -> str:
    """kind, doc_id, start and stop of matches; m is the match, v its digits."""
    return f"""select doc_id, '{kind}' as kind, {KINDS.index(kind)} as k, a, a + len(m) as b from (select doc_id, ms[i] as m, regexp_replace(ms[i], '[^0-9]', '', 'g') as v,
cast(coalesce(list_sum(list_transform(ps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) as bigint) as a
from (select doc_id, ms, ps, unnest(range(1, len(ms) + 1)) as i from (select doc_id, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as ps from t))) where {good}"""


#: The base columns of op7.
BASE_SQL = f"""with t as (select doc_id, coalesce(text, '') as text from documents),
s as ({_kind_sql("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "true")}
union all {_kind_sql("ip", "[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: cast(x as hugeint))) <= 255")}
union all {_kind_sql("card", "[0-9]([ -]?[0-9])+", "len(v) between 14 and 19 and list_sum(list_transform(range(1, len(v) + 1), lambda i: case when (len(v) - i) % 2 = 0 then cast(v[i] as integer) when v[i] >= '5' then 2 * cast(v[i] as integer) - 9 else 2 * cast(v[i] as integer) end)) % 10 = 0")}
union all {_kind_sql("phone", "[+][0-9][ ().0-9-]+[0-9]", "len(v) between 10 and 15")}),
g as (select doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone, string_agg(kind || ':' || cast(a as varchar) || ':' || cast(b as varchar), ',' order by a, k) as d from s group by doc_id)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(d, '')) as base_sha256 from t left join g using (doc_id)"""


def redact(text: str | None) -> str | None:
    """Each span, or run of overlapping spans, becomes its first kind in angle brackets."""
    if not text:
        return text
    _, spans = all_spans(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind's name in place of every span; n_chars, where there is one, counts the new text.

    Null and empty texts stay as they are, repeated rows get equal texts, other columns of any name pass unchanged; an empty
    table gives an empty table.
    """
    from pyspark.sql import functions as F

    clean = replace_text(docs, "text", lambda: redact)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
