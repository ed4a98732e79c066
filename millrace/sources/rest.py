"""Reads from a REST catalogue: who asks, below which prefix, and a namespace's properties.

Requests go through ``send`` (method, url, headers, form or None) -> parsed JSON, by default urllib, so that everything
but the network itself can be used offline.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.text import catalog_url
from ..model import ContractError

# Fixed values of the protocol.
SCOPE = "PRINCIPAL_ROLE:ALL"
GRANT = "client_credentials"


def over_http(method: str, url: str, headers: dict[str, str], form: dict[str, str] | None):
    body = urllib.parse.urlencode(form).encode() if form is not None else None
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=30) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as error:
        raise OSError(f"{method} {url}: {error.code}") from error


@dataclass
class RestCatalog:
    """``properties`` as in a catalogue's configuration: bearer_token, or client_id and client_secret, or neither."""

    endpoint: str
    warehouse: str
    properties: dict[str, str] = field(default_factory=dict)
    send: Callable = over_http
    _granted: tuple[str, float] | None = None

    def token(self) -> str | None:
        """The given token, else one asked for with the client's credentials and kept until a minute before it ends."""
        if "bearer_token" in self.properties:
            return self.properties["bearer_token"]
        if "client_id" not in self.properties and "client_secret" not in self.properties:
            return None
        if self._granted is None or self._granted[1] <= time.monotonic():
            try:
                form = {"grant_type": GRANT, "client_id": self.properties["client_id"], "client_secret": self.properties["client_secret"], "scope": SCOPE}
            except KeyError as missing:
                raise ContractError(f"catalog credentials need {missing.args[0]}") from None
            answer = self.send("POST", catalog_url(self.endpoint, "v1", "oauth", "tokens"), {"Accept": "application/json"}, form)
            if not answer.get("access_token"):
                raise ContractError("the catalogue gave no token")
            self._granted = answer["access_token"], time.monotonic() + float(answer.get("expires_in", 0)) - 60
        return self._granted[0]

    def headers(self) -> dict[str, str]:
        token = self.token()
        return {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def _get(self, url: str):
        return self.send("GET", url, self.headers(), None)

    def prefix(self) -> str:
        """Where the catalogue says the warehouse is: by its defaults, else by its overrides, else the warehouse's own name."""
        told = self._get(f"{catalog_url(self.endpoint, 'v1', 'config')}?{urllib.parse.urlencode({'warehouse': self.warehouse})}")
        return (told.get("defaults") or {}).get("prefix") or (told.get("overrides") or {}).get("prefix") or self.warehouse

    def namespace_properties(self, namespace: str) -> dict[str, str]:
        """Dots part the levels of a namespace, which the protocol joins by the unit separator."""
        return self._get(catalog_url(self.endpoint, "v1", self.prefix(), "namespaces", namespace.replace(".", "\x1f"))).get("properties") or {}
