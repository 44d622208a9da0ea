"""Where replies come from: settings, providers, and the call loop of one partition."""

from __future__ import annotations

import http.client
import json
import os
import re
import threading
from dataclasses import dataclass
from typing import NamedTuple, Protocol
from urllib.parse import SplitResult, urlsplit

from weftwork.model import MAX_RETRIES, MAX_TOKENS, TEMPERATURE, TIMEOUT_S, ExtractorConfig, ProviderConfig, ProviderError, SchemaSpec
from weftwork.operators.prompt import request_json
from weftwork.operators.repair import looks_truncated, parse_failure

#: End points of local servers, and the variables that hold keys of services.
LOCAL_URLS = {"lmstudio": "http://localhost:1234/v1", "ollama": "http://localhost:11434/v1"}
SERVICE_URLS = {"openai": "https://api.openai.com/v1"}
KEY_VARIABLES = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}
#: Stop sequences a service accepts, response formats we can build.
MAX_STOPS = 4
FORMATS = ("json_object", "json_schema")


class Reply(NamedTuple):
    content: str
    finish_reason: str | None = None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class Provider(Protocol):
    def complete(self, key, prompt: str, attempt: int) -> Reply: ...


def base_url(config: ProviderConfig) -> str:
    """End point; a service that is neither local nor known needs one of its own."""
    url = config.base_url or LOCAL_URLS.get(config.type) or SERVICE_URLS.get(config.type)
    if not url:
        raise ValueError(f"provider {config.type!r} needs a base URL")
    return url.rstrip("/")


def api_key(config: ProviderConfig, env=os.environ) -> str:
    """The given key, else that of the environment where the call runs; '' for local servers."""
    if config.api_key:
        return config.api_key
    return "" if config.type in LOCAL_URLS else env.get(KEY_VARIABLES.get(config.type, ""), "")


def mask_secrets(message: str) -> str:
    return re.sub(r"sk-[A-Za-z0-9_-]+", "sk-***", message)


def positive_int(text: str | None, name: str) -> int | None:
    """The integer a text begins with, as a limit."""
    if text is None:
        return None
    m = re.match(r"\s*([+-]?\d+)", text)
    if not m or int(m.group(1)) < 1:
        raise ValueError(f"{name} must be a positive integer")
    return int(m.group(1))


def stop_sequences(given: list[str], listed: str | None) -> tuple[str, ...]:
    """Given ones as they are, else those of a comma-separated list, trimmed, blanks dropped."""
    stops = tuple(given) or tuple(s.strip() for s in (listed or "").split(",") if s.strip())
    if len(stops) > MAX_STOPS:
        raise ValueError(f"at most {MAX_STOPS} stop sequences are supported")
    return stops


def response_format_name(text: str | None) -> str | None:
    if not text:
        return None
    if text not in FORMATS:
        raise ValueError(f"response format must be one of {', '.join(FORMATS)}")
    return text


def resolve_provider(args: dict, env=os.environ, prefix: str = "WEFTWORK_") -> ProviderConfig:
    """Command line before environment before default."""

    def of(name, default=None):
        return args.get(name) or env.get(prefix + name.upper()) or default

    return ProviderConfig(
        type=of("provider", "lmstudio"),
        model=of("model", ""),
        base_url=of("base_url"),
        api_key=of("api_key"),
        stop=stop_sequences(args.get("stop") or [], env.get(prefix + "STOP")),
        response_format=response_format_name(of("response_format")),
    )


def reply_content(message: dict | None) -> str | None:
    """First of content and the two spellings of reasoning content that is text and not blank, untrimmed."""
    for name in ("content", "reasoning_content", "reasoningContent"):
        value = message.get(name) if isinstance(message, dict) else None
        if isinstance(value, str) and value.strip():
            return value
    return None


#: Connections of this thread, by scheme and host.
_OPEN = threading.local()


def _connection(url: SplitResult, fresh: bool = False) -> http.client.HTTPConnection:
    """The connection that this thread keeps to a service; a new one if there is none or ``fresh``."""
    kept = _OPEN.__dict__.setdefault("kept", {})
    key = (url.scheme, url.netloc)
    if fresh and key in kept:
        kept.pop(key).close()
    if key not in kept:
        kind = http.client.HTTPSConnection if url.scheme == "https" else http.client.HTTPConnection
        kept[key] = kind(url.netloc, timeout=TIMEOUT_S)
    return kept[key]


def _post(url: str, body: str, headers: dict[str, str]) -> bytes:
    """The body of an answer; an idle connection that the service has closed is opened once more."""
    parts = urlsplit(url)
    path = parts.path + (f"?{parts.query}" if parts.query else "")
    for fresh in (False, True):
        connection = _connection(parts, fresh)
        idle = connection.sock is not None
        try:
            connection.request("POST", path, body.encode(), headers)
            answer = connection.getresponse()
            data = answer.read()
        except (ConnectionError, http.client.RemoteDisconnected, http.client.CannotSendRequest):
            connection.close()
            if fresh or not idle:
                raise
            continue
        except Exception:
            connection.close()
            raise
        if answer.status >= 400:
            raise OSError(f"HTTP {answer.status}: {data[:500].decode('utf-8', 'replace')}")
        return data
    raise AssertionError("unreachable")


@dataclass(frozen=True)
class HttpProvider:
    """Any chat-completion service; built on the executor, so that keys stay out of plans."""

    config: ProviderConfig
    spec: SchemaSpec = SchemaSpec()
    temperature: float = TEMPERATURE
    max_tokens: int = MAX_TOKENS

    def complete(self, key, prompt: str, attempt: int) -> Reply:
        body = request_json(prompt, self.config, self.spec, self.temperature, self.max_tokens)
        headers = {"Content-Type": "application/json"}
        if token := api_key(self.config):
            headers["Authorization"] = f"Bearer {token}"
        try:
            data = json.loads(_post(f"{base_url(self.config)}/chat/completions", body, headers))
            choice = (data.get("choices") or [{}])[0] or {}
            content, usage = reply_content(choice.get("message")), data.get("usage") or {}
            counts = [usage.get(n) for n in ("prompt_tokens", "completion_tokens")]
        except Exception as error:
            raise ProviderError(f"LLM request failed: {mask_secrets(str(error))}", error) from error
        if content is None:
            raise ProviderError("Empty response from LLM")
        return Reply(content, choice.get("finish_reason"), *counts)


@dataclass(frozen=True)
class RuleProvider:
    """A pseudo-model for tests: capitalised words are nodes, neighbours in a line are edges.

    The defects of its replies follow the key, so that every repair is exercised. All
    names of a text are taken unless ``max_nodes`` or the limits of the prompt say otherwise.
    """

    max_nodes: int | None = None

    def complete(self, key, prompt: str, attempt: int) -> Reply:
        text, _, told = prompt.partition("\nTEXT:\n")[2].rpartition("\n\nENTITY TYPES: ")
        asked = re.findall(r"\n\nOUTPUT LIMITS:\n- max nodes: (\d+)\n", told)
        limit = min((n for n in (self.max_nodes, *map(int, asked[-1:])) if n is not None), default=None)
        ids: dict[str, str] = {}
        edges = []
        for line in text.split("\n"):
            last = None
            for name in re.findall(r"\b[A-Z][a-z]{2,}\b", line):
                if limit is not None and name not in ids and len(ids) >= limit:
                    continue
                mine = ids.setdefault(name, f"node_{len(ids) + 1}")
                if last and last != mine:
                    edges.append({"id": f"edge_{len(edges) + 1}", "source": last, "target": mine, "type": "related_to"})
                last = mine
        nodes = [{"id": i, "label": name, "type": "concept"} for name, i in ids.items()]
        defect = int(key) % 8
        if defect == 4:
            edges.append({"id": "edge_x", "source": "node_1", "target": "node_none", "type": "part_of"})
        if defect == 5 and nodes:
            nodes.append(nodes[0])
        raw = json.dumps({"nodes": nodes, "edges": edges})
        if defect == 1:
            raw = f"```json\n{raw}\n```"
        elif defect == 2:
            raw = f"Here is the graph:\n{raw}\nDone."
        elif defect == 3:
            raw = raw[:-2] + ",]}" if edges else raw
        elif defect == 6 and attempt == 0:
            return Reply(raw[: len(raw) // 2 + 1], "length", len(prompt) // 4, len(raw) // 8)
        return Reply(raw, "stop", len(prompt) // 4, len(raw) // 4)


@dataclass(frozen=True)
class Outcome:
    status: str
    error: str | None
    raw: str | None
    finish_reason: str | None
    attempts: int
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


def should_retry(raw: str, previous: str | None, finish_reason: str | None) -> bool:
    """Not if the same reply came before, nor if the model says it had finished a reply that breaks off."""
    if previous and raw == previous:
        return False
    return not (finish_reason == "stop" and looks_truncated(raw))


def call(provider: Provider, key, prompt: str, max_retries: int = MAX_RETRIES) -> Outcome:
    """Ask until a reply parses; a provider's error ends the attempts."""
    previous, failure, reply, made = None, None, None, 0
    for attempt in range(max_retries + 1):
        made += 1
        try:
            reply = provider.complete(key, prompt, attempt)
        except ProviderError as error:
            return Outcome("provider_error", str(error), None, None, made)
        failure = parse_failure(reply.content)
        if failure is None:
            return Outcome("ok", None, reply.content, reply.finish_reason, made, reply.prompt_tokens, reply.completion_tokens)
        if reply.finish_reason:
            failure += f" (finish_reason: {reply.finish_reason})"
        if not should_retry(reply.content, previous, reply.finish_reason):
            break
        previous = reply.content
    return Outcome("parse_error", failure or "Failed to parse LLM response", reply.content if reply else None, reply.finish_reason if reply else None, made)


def http_provider(config: ExtractorConfig, spec: SchemaSpec, temperature: float | None = None) -> HttpProvider:
    """Call before configuration before default."""
    heat = next(t for t in (temperature, config.temperature, TEMPERATURE) if t is not None)
    return HttpProvider(config.provider, spec, heat, MAX_TOKENS if config.max_tokens is None else config.max_tokens)
