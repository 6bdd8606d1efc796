"""Rewriting through public chat endpoints, with an injectable transport so that nothing here needs a network to be tested."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from ..operators.rewriting import QuotaExhausted

Post = Callable[[str, dict, dict], dict]


def post_json(url: str, body: dict, headers: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=300) as r:
        return json.load(r)


def openai_shape(model: str, prompt: str, text: str, placement: str, max_tokens: int, temperature: float) -> dict:
    messages = [{"role": "system", "content": prompt}, {"role": "user", "content": text}] if placement == "system" else [{"role": "user", "content": prompt.replace("{text}", text)}]
    return {"model": model, "messages": messages, "max_completion_tokens": max_tokens, "temperature": temperature}


def anthropic_shape(model: str, prompt: str, text: str, placement: str, max_tokens: int, temperature: float) -> dict:
    body = {"model": model, "max_tokens": max_tokens, "temperature": temperature, "messages": [{"role": "user", "content": text if placement == "system" else prompt.replace("{text}", text)}]}
    return body | ({"system": prompt} if placement == "system" else {})


def google_shape(model: str, prompt: str, text: str, placement: str, max_tokens: int, temperature: float) -> dict:
    body = {"contents": [{"role": "user", "parts": [{"text": text if placement == "system" else prompt.replace("{text}", text)}]}], "generationConfig": {"maxOutputTokens": max_tokens, "temperature": temperature}}
    return body | ({"systemInstruction": {"parts": [{"text": prompt}]}} if placement == "system" else {})


SHAPES = {
    "openai": (openai_shape, lambda r: r["choices"][0]["message"]["content"]),
    "anthropic": (anthropic_shape, lambda r: r["content"][0]["text"]),
    "google": (google_shape, lambda r: r["candidates"][0]["content"]["parts"][0]["text"]),
}


@dataclass
class ChatEndpoint:
    """A RewriteProvider over one endpoint; url and headers come from the caller."""

    kind: str
    url: str
    headers: dict
    post: Post = post_json
    max_tokens: int = 4096
    temperature: float = 0.7
    pause: float = 0.5

    def rewrite(self, text: str, model: str, prompt: str, placement: str = "user") -> str:
        shape, read = SHAPES[self.kind]
        instruction = prompt.replace("{text}", "").strip() if placement == "system" else prompt
        answer = self.post(self.url, shape(model, instruction, text, placement, self.max_tokens, self.temperature), self.headers)
        if "insufficient_quota" in json.dumps(answer.get("error", "")):
            raise QuotaExhausted(str(answer["error"]))
        time.sleep(self.pause)
        return read(answer).strip()


@dataclass
class BatchEndpoint:
    """Submit request lines as one batch and wait for it; ids are kept by (condition, model) by the caller."""

    submit_url: str
    status_url: Callable[[str], str]
    headers: dict
    post: Post = post_json
    wait: float = 60.0
    sleep: Callable[[float], None] = time.sleep

    def submit(self, requests: list[dict]) -> str:
        return self.post(self.submit_url, {"requests": requests}, self.headers)["id"]

    def poll(self, batch: str, longest: float = 86_400.0) -> list[dict]:
        waited = 0.0
        while True:
            state = self.post(self.status_url(batch), {}, self.headers)
            if state["status"] in ("completed", "ended"):
                return [r for r in state.get("results", []) if not r.get("error")]
            if state["status"] in ("failed", "expired", "cancelled"):
                raise RuntimeError(f"batch {batch}: {state['status']}")
            if waited >= longest:
                raise TimeoutError(f"batch {batch} has not ended after {longest:.0f} s")
            self.sleep(self.wait)
            waited += self.wait
