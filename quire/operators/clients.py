"""Model clients over HTTP, as functions for ``Transform``: ``fn(system, text) -> text``.

Both speak public protocols with the standard library alone, so nothing but the
module goes to the executors; ``post`` may be exchanged in tests.  Keys are read
from an environment variable of the executor, never from the plan.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable

from .stage import REFUSALS, RETRYABLE, Blocked, Empty, Retryable, Transform

Post = Callable[[str, dict, dict], dict]


def post(url: str, headers: dict, body: dict, seconds: float = 600) -> dict:
    """The JSON answer to a JSON request; an error that may pass is ``Retryable``, any other is raised."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code in RETRYABLE:
            raise Retryable(e.code) from e
        raise
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Retryable() from e


def generate(
    model: str, base: str = "https://generativelanguage.googleapis.com/v1beta", key: str = "GEMINI_API_KEY", temperature: float = 0.1, thinking: str | None = None, send: Post = post,
) -> Callable[[str, str], str]:
    """A client of the generateContent protocol.  A refused prompt or answer is ``Blocked``, an answer without text ``Empty``."""

    def ask(system: str, text: str) -> str:
        config = {"temperature": temperature} | ({"thinkingConfig": {"thinkingLevel": thinking}} if thinking else {})
        body = {"contents": [{"role": "user", "parts": [{"text": text}]}], "generationConfig": config}
        if system:
            body["systemInstruction"] = {"parts": [{"text": system}]}
        said = send(f"{base}/models/{model}:generateContent", {"x-goog-api-key": os.environ.get(key, "")}, body)
        if (said.get("promptFeedback") or {}).get("blockReason"):
            raise Blocked()
        first = (said.get("candidates") or [{}])[0]
        if first.get("finishReason") in REFUSALS:
            raise Blocked()
        out = "".join(p.get("text", "") for p in (first.get("content") or {}).get("parts") or [] if not p.get("thought"))
        if not out.strip():
            raise Empty()
        return out

    return ask


def chat(model: str, base: str, key: str = "CHAT_API_KEY", temperature: float = 0.2, max_tokens: int = 16384, send: Post = post) -> Callable[[str, str], str]:
    """A client of the chat completions protocol."""

    def ask(system: str, text: str) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": text}]
        said = send(f"{base.rstrip('/')}/chat/completions", {"Authorization": f"Bearer {os.environ.get(key, '')}"}, {"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens})
        first = (said.get("choices") or [{}])[0]
        if first.get("finish_reason") == "content_filter":
            raise Blocked()
        out = (first.get("message") or {}).get("content") or ""
        if not out.strip():
            raise Empty()
        return out

    return ask


def generating(model: str, fallback: Transform | None = None, **more) -> Transform:
    """A generateContent model with its profile: 5 calls, waits from 5 to 120 seconds."""
    return Transform(model, generate(model, **more), retries=5, delay=5.0, max_delay=120.0, fallback=fallback)


def chatting(model: str, base: str, fallback: Transform | None = None, **more) -> Transform:
    """A chat model with its profile: 8 calls, waits from 5 to 180 seconds."""
    return Transform(model, chat(model, base, **more), retries=8, delay=5.0, max_delay=180.0, fallback=fallback)
