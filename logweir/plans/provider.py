"""Mapping providers around a text model: prompt, retries, reading the answer. The model itself is the caller's."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from ..schema import CANONICAL
from .semantic import Bypass, check_mapping

# How often a call is tried, and what tells that trying on is useless.
ATTEMPTS = 5
QUOTA = ("insufficient_quota", "exceeded your current quota", "billing")
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)


def build_prompt(lines: Sequence[str], signatures: Sequence[str], examples: Sequence[str] = ()) -> str:
    """Asks for a JSON list with one object a line: signature, fields, confidence, parse_flags."""
    parts = [
        "Write regular expressions that take values out of log lines of semiconductor tools.",
        "For each line return an object with signature, fields (name to a pattern with one group), confidence (0 to 1) and parse_flags.",
        "Allowed names: " + ", ".join(sorted(CANONICAL)) + ".",
    ]
    if examples:
        parts += ["Lines that are alike:", *(f"- {x}" for x in examples)]
    parts += ["Lines:", *(f"{s}: {x}" for s, x in zip(signatures, lines)), "Answer with a JSON list only."]
    return "\n".join(parts)


def parse_response(text: str, signatures: Sequence[str]) -> list[dict]:
    """One checked mapping for each signature, whatever the answer holds: fences are taken off, what is missing is empty, what is too much is dropped."""
    found = _FENCE.search(text)
    try:
        answer = json.loads((found[1] if found else text).strip())
    except ValueError:
        answer = []
    answer = answer if isinstance(answer, list) else [answer] if isinstance(answer, dict) else []
    padded = [*answer, *({} for _ in signatures)][: len(signatures)]
    return [{"signature": s, **check_mapping(a)} for s, a in zip(signatures, padded)]


@dataclass
class TextModel:
    """A provider that asks ``call`` (prompt to answer). Waits 1, 2, 4, ... seconds between tries; a quota error or the last failure maps nothing, flagged."""

    call: Callable[[str], str]
    attempts: int = ATTEMPTS
    wait: Callable[[float], None] = time.sleep
    examples: Sequence[str] = field(default_factory=tuple)

    def generate(self, lines: Sequence[str], signatures: Sequence[str]) -> list[dict]:
        reason = "llm_failed"
        for attempt in range(self.attempts):
            try:
                return parse_response(self.call(build_prompt(lines, signatures, self.examples)), signatures)
            except Exception as e:  # whatever the caller's client raises
                if any(q in str(e).lower() for q in QUOTA):
                    reason = "llm_quota_exceeded"
                    break
                if attempt + 1 < self.attempts:
                    self.wait(2.0**attempt)
        return [{**m, "parse_flags": [reason]} for m in Bypass().generate(lines, signatures)]
