"""Remote backends of ``ranking.overlay``: they word an answer anew, or judge one."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass
from urllib.parse import urlsplit


@dataclass(frozen=True)
class ChatRewriter:
    """A chat-completions service. Its key is only sent over https or to this machine."""

    url: str
    model: str
    key: str | None = None
    timeout: float = 30.0

    def _headers(self) -> dict[str, str]:
        at = urlsplit(self.url)
        safe = at.scheme == "https" or at.hostname in ("localhost", "127.0.0.1", "::1")
        return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key and safe else {})

    def ask(self, system: str, user: str) -> str | None:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), self._headers())
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    def rewrite(self, context: str, question: str) -> str | None:
        return self.ask("Responda apenas com o trecho dado. Sem resposta nele, diga NAO CONSTA.", f"Trecho: {context}\nPergunta: {question}")


@dataclass(frozen=True)
class Judge:
    """Keeps a local answer's words only if a chat service calls them right; else it says nothing, and the local answer stays."""

    chat: ChatRewriter

    def rewrite(self, context: str, question: str) -> str | None:
        said = self.chat.ask("Responda sim ou nao: o trecho responde a pergunta?", f"Trecho: {context}\nPergunta: {question}")
        return context if said and said.strip().lower().startswith("sim") else None
