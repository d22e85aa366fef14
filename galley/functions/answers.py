"""Model answers as text: balanced JSON objects, repair, schema checks. Plain functions; operators.answers applies them."""

from __future__ import annotations

import json
import re

#: Fields that list the pages an answer has checked, in order of preference.
CHECKED = ("checked_pages", "pages_checked")


def _scan(text: str, start: int) -> dict[int, int]:
    """Where each brace that opens outside strings closes, reading from start, itself an opening brace, until it closes or the text ends."""
    closes, opened, quoted, escaped = {}, [], False, False
    for k in range(start, len(text)):
        ch = text[k]
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch == "{":
            opened.append(k)
        elif ch == "}" and opened:
            closes[opened.pop()] = k + 1
            if not opened:
                break
    return closes | dict.fromkeys(opened, 0)


def balanced_objects(text: str) -> list[str]:
    """Every outermost {...} of a text, with braces inside strings left alone. A brace that never closes hides nothing: the search goes on behind it.

    What one scan learns of the braces inside is kept, so that only braces within what looked like a string are read anew.
    """
    out, known, at = [], {}, text.find("{")
    while at >= 0:
        if at not in known:
            known |= _scan(text, at)
        if known[at]:
            out.append(text[at : known[at]])
        at = text.find("{", known[at] or at + 1)
    return out


def strip_fence(text: str) -> str:
    """The inside of one ``` fence, or the text; trimmed."""
    inside = re.fullmatch(r"```[a-zA-Z0-9_-]*\s*\n(.*?)\n```", text.strip(), re.DOTALL)
    return (inside[1] if inside else text).strip()


def turn_completion(text: str | None, marker: str | None) -> str:
    """complete (the marker ends the text, as a word of its own, behind a JSON object), marked (behind anything else), or waiting."""
    text, marker = (text or "").rstrip(), marker or ""
    before = text[: len(text) - len(marker)]
    if not marker or not text.endswith(marker) or not (before == "" or before[-1].isspace() or before[-1] == "}"):
        return "waiting"
    body = strip_fence(before)
    first = body.find("{")
    end = _scan(body, first)[first] if first >= 0 else 0
    try:
        return "complete" if end and isinstance(json.loads(body[first:end]), dict) else "marked"
    except ValueError:
        return "marked"


def _closed(text: str) -> str:
    """The text with whatever is open at its end closed."""
    stack, quoted, escaped = [], False, False
    for ch in text:
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
    if quoted:
        text += '"'
    return re.sub(r"[,:\s]+$", "", text) + "".join(reversed(stack))


def _last_whole(text: str) -> str | None:
    """The text up to its last whole object within an array, with the rest dropped and everything closed."""
    for k in range(len(text) - 1, 0, -1):
        if text[k] == "}":
            cut = _closed(text[: k + 1])
            try:
                json.loads(cut)
                return cut
            except ValueError:
                continue
    return None


def repair_json(text: str) -> tuple[str | None, list[str]]:
    """(JSON, fixes made in order), or (None, fixes) where nothing helps. A valid text is returned as it is."""

    def valid(t: str) -> bool:
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    fixes: list[str] = []
    if valid(text):
        return text, fixes
    steps = (
        ("prose_quotes", lambda t: re.sub(r'(?<=[\w.,])"(?=[\w][^":,}\]]*"\s*[\w.])|(?<=[a-z ])"(?=[A-Za-z ]+" [a-z])', '\\"', t)),
        ("open_quote", lambda t: re.sub(r'([{,]\s*)([A-Za-z_]\w*)"\s*:', r'\1"\2":', t)),
        ("trailing_comma", lambda t: re.sub(r",(\s*[}\]])", r"\1", t)),
        ("invalid_escape", lambda t: re.sub(r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})', r"\\\\", t)),
    )
    for name, step in steps:
        now = step(text)
        if now != text and (valid(now) or name != "prose_quotes"):
            text, fixes = now, [*fixes, name]
            if valid(text):
                return text, fixes
    closed = _closed(text)
    if valid(closed):
        return closed, [*fixes, "truncated_tail"]
    whole = _last_whole(text)
    return (whole, [*fixes, "dropped_partial"]) if whole else (None, fixes)


def check_answer(value, packet_id: str | None, expected: list[int]) -> list[str]:
    """What is wrong with a parsed answer; empty if nothing is."""
    if not isinstance(value, dict):
        return ["not_an_object"]
    wrong = []
    if packet_id is not None and value.get("packet_id") not in (None, packet_id):
        wrong.append("packet_id")
    findings = value.get("findings")
    if not isinstance(findings, list) or any(not isinstance(f, dict) for f in findings):
        wrong.append("findings")
    pages = next((value[k] for k in CHECKED if isinstance(value.get(k), list)), [])
    if any(not isinstance(p, int) or isinstance(p, bool) or p not in expected for p in pages):
        wrong.append("pages")
    return wrong


def pick_answer(text: str, packet_id: str, expected: list[int]) -> tuple[str | None, list[str]]:
    """(answer JSON, fixes): of the objects with findings or a read error that fit, the last in the text; of two at one place the one that needed no repair.

    Objects come from the text and, where that mends it, from the repaired text. A missing packet_id is filled in, but such
    an answer counts only if none that names the packet fits.
    """
    begin, fit = max(text.find("{"), 0), []
    whole, mended = repair_json(text[begin:])
    tries = [(text, 0, [])] + ([(whole, begin, mended)] if whole and mended else [])
    for source, offset, made in tries:
        for k, raw in enumerate(balanced_objects(source)):
            fixed, fixes = repair_json(raw) if '"findings"' in raw or '"read_error"' in raw else (None, [])
            value = json.loads(fixed) if fixed else None
            if not isinstance(value, dict):
                continue
            fixes = [*made, *fixes]
            if not str(value.get("packet_id") or "").strip():
                value, fixes = value | {"packet_id": packet_id}, [*fixes, "missing-packet-id"]
            if value["packet_id"] == packet_id and not check_answer(value, packet_id, expected):
                fit.append((offset + source.rfind(raw), not fixes, k, json.dumps(value, ensure_ascii=False, sort_keys=True), fixes))
    fit = [f for f in fit if "missing-packet-id" not in f[4]] or fit
    return max(fit, key=lambda f: f[:3])[3:] if fit else (None, [])
