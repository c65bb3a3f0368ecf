"""HTTP calls for a ledger: one request row in, its response columns out."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import Row

from pelorus.plans.limits import HostCoordinator


def fetch(method: str, url: str, headers: Mapping[str, str] | None = None, body: str | None = None, ephemeral: Mapping[str, str] | None = None, timeout: float = 60.0) -> dict[str, Any]:
    """Status, headers, text, size, latency and time of one call. ``ephemeral`` headers (secrets) are sent, never stored.

    A status of any kind is an answer; no answer at all raises ``OSError``. Bytes that are no UTF-8 are replaced.
    """
    if urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"no HTTP address: {url}")
    sent = {**(headers or {}), **(ephemeral or {})}
    request = urllib.request.Request(url, data=None if body is None else body.encode("utf-8"), headers=sent, method=method.upper())
    at, began = datetime.now(timezone.utc).replace(tzinfo=None), time.monotonic()
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            status, found, data = answer.status, dict(answer.headers), answer.read()
    except urllib.error.HTTPError as e:
        with e:
            status, found, data = e.code, dict(e.headers), e.read()
    return {
        "response_status": status,
        "response_headers": json.dumps(found),
        "response_body_text": data.decode("utf-8", "replace"),
        "response_size": len(data),
        "latency": time.monotonic() - began,
        "requested_at_utc": at,
    }


def caller(secrets: Mapping[str, str] | None = None, hosts: HostCoordinator | None = None, get: Callable[..., dict[str, Any]] = fetch) -> Callable[[Row], dict[str, Any]]:
    """A ledger's ``call``: secrets stay in the closure; with ``hosts`` an outage is waited for and the call repeated."""

    def call(request: Row) -> dict[str, Any]:
        headers = json.loads(request["request_headers"]) if request["request_headers"] else {}
        host = urlsplit(request["request_url"]).netloc
        while True:
            epoch = hosts.ready(host) if hosts else 0
            try:
                answer = get(request["request_method"] or "GET", request["request_url"], headers, request["request_body"], secrets)
            except OSError:
                if not hosts:
                    raise
                hosts.report(host, epoch, None)
                continue
            if not hosts or not hosts.report(host, epoch, answer["response_status"]):
                return answer

    return call
