"""A transport over HTTP for the harvest and enrichment clients."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from typing import Any

from noveltide.sources.harvest import Response


class HttpTransport:
    """GET requests to ``url`` (``{eid}`` in it is filled from the parameters; the others go into the query)."""

    def __init__(self, url: str, headers: dict[str, str], timeout: float = 60.0):
        self.url, self.headers, self.timeout = url, headers, timeout

    def __call__(self, params: dict[str, Any]) -> Response:
        rest = dict(params)
        url = self.url
        if "{eid}" in url:
            url = url.replace("{eid}", urllib.parse.quote(str(rest.pop("eid")), safe=""))
        if rest:
            url = f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(rest)}"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as r:
                return Response(r.status, json.loads(r.read() or b"{}"), dict(r.headers))
        except urllib.error.HTTPError as e:
            return Response(e.code, {}, dict(e.headers or {}))
