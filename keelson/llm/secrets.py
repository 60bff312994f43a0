"""Secret scans: fixed patterns, and strings that a primed compressor can't shorten.

Beside the fixed patterns, each token of LEAST_LENGTH characters or more near a sensitive word is measured by the
bytes that it adds to a zstandard frame. The dictionary of the compressor holds common identifiers and the whole text
around the candidates, so what recurs there costs a few bytes, however long. What doesn't recur is written as
literals, whose codes the frame has fitted to the prime before it; of the primes - prose and code, numbers,
capitals - the cheapest counts. Words and names then cost about half a byte a character, dates and numbers less,
and random strings nearly a byte, as their letters, digits and capitals fit no prime. The added bytes alone decide.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from keelson.llm.common import map_batches

KINDS = ("assign", "access", "hex", "novel")
#: Candidates: a token at least so long, at most so far behind a sensitive word.
LEAST_LENGTH, REACH = 8, 48
#: Added bytes by character above which a candidate is reported, once the bytes that a frame may be off (its end, a code table that the token changes) are taken off.
NOVELTY, SLACK = 0.65, 1

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # runs of 16 characters at least
_HEX = re.compile(r"[0-9a-f]{32,}")
_SENSITIVE = re.compile(r"(?i:passwords?|passwds?|passw|pwds?|secrets?|tokens?|api[_-]?keys?|credentials?|private|auth(?:orization|entication)?|bearer|signatures?|client[_-]?ids?|access[_-]?keys?)(?![a-z])", re.ASCII)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_LENGTH)
_BEGINS = re.compile(r"[A-Za-z0-9+/_=-]{%d}" % LEAST_LENGTH)

#: Identifiers and prose that recur in code and configuration.
IDENTIFIERS = """
import from return class function const public private static void string boolean integer value default
password passwd secret token api_key apikey access_key private_key client_id client_secret authorization bearer
username user_name account identifier session cookie signature credential certificate encrypt decrypt hash
localhost example.com http https json yaml environment variable configuration settings parameter argument
get_value set_value get_token set_token get_password set_password refresh_token access_token auth_token
YOUR_API_KEY YOUR_TOKEN_HERE your-secret-key changeme placeholder xxxxxxxxxxxxxxxx 0000000000000000
ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 0123456789abcdef
sha256sum md5sum sha512 base64encode X-Forwarded-For Content-Type application/json DATABASE_URL /usr/local/lib/python3
BEGIN RSA PRIVATE KEY PUBLIC CERTIFICATE REDIRECT_URI ACCESS_TOKEN_URL max_retry_count oauth2 http2 utf-8 x86_64
"""  # fmt: skip

#: What literals are fitted to: running text and code, numbers, and (made below) capitals.
PROSE = """
Please remember to change the default value before the first release, since it is written in the public documentation.
The quick settings of an account are stored by the server and read again whenever the user signs in from another device.
When the request fails, the client waits for some seconds, checks the connection and then tries again with the same header.
Every function returns a string or raises an exception; arguments that are missing fall back to what the configuration says.
def get_value_from_config(name, default=None): return environment.get(name, default)
class UserAccountManager: private static final String accountIdentifier; public boolean isRequired() { return false; }
El usuario debe cambiar la configuracion antes de entrar en el sistema, y guardar los documentos en otra carpeta nueva.
Der Benutzer soll die Einstellungen vor der naechsten Anmeldung aendern und alle wichtigen Dateien sichern lassen.
The rest of the section describes how the tests are started, where their results are written and who reads them later on.
There is no need to restart the machine after the update of 2024 unless the notes of the release say so in their opening sentence.
He asked her whether the letters had arrived at the station, and she answered that the train was late again that evening.
for entry in entries: total = total + entry.amount; if total > limit: raise ValueError(message)
Les utilisateurs doivent modifier leurs parametres avant la prochaine connexion et garder une copie de chaque fichier.
"""  # fmt: skip
NUMBERS = """
2019-01-31 08:24:57 127.0.0.1 192.168.10.24 +1 555 0100 4871 2.718281828 3.14159 1970 65536 86400 0x7f 1024 2048 9036 5512
1999-12-30 23:59:46 10.0.3.68 v1.20.7 300 450 875 6201 7349 8153 #4096 7780 1361 5938 0246 8024 5791 3467 1200 0042 2550
2024/11/05 17:31:08 555-0100-2938 4716 0093 8842 61.75 -13.08 90210 44871 3356 7129 8604 2217 9350 6648 0571 2086 4793
"""  # fmt: skip
#: Text is taken in two orders: a frame's size jumps by some bytes with its code table, and the lesser one counts.
_TURNED = "\n".join(reversed(PROSE.split("\n")))
PRIMES = tuple(x.encode() for x in (PROSE, _TURNED, NUMBERS, PROSE.upper(), _TURNED.upper()))


class Novelty:
    """Measures tokens against identifiers and a text."""

    def __init__(self, around: str):
        primed = zstandard.ZstdCompressionDict((IDENTIFIERS + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)
        primed.precompute_compress(compression_params=settings)  # loaded once for all tokens
        self._press = zstandard.ZstdCompressor(compression_params=settings, dict_data=primed).compress
        self._bare = [len(self._press(x)) for x in PRIMES]

    def added(self, token: str) -> int:
        """The bytes that a token adds at least."""
        data = token.encode()
        return min(len(self._press(x + data)) - bare for x, bare in zip(PRIMES, self._bare))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Tokens that begin up to REACH behind a sensitive word, clear of the spans taken. Time is linear in the text."""
    out, done, k = [], 0, 0
    taken = sorted(taken)
    for word in _SENSITIVE.finditer(text):
        # only beginnings within reach are looked for
        while m := _BEGINS.search(text, max(done, word.end()), min(len(text), word.end() + REACH + LEAST_LENGTH)):
            start, done = m.start(), _TOKEN.match(text, m.start()).end()
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if not any(s < done and start < e for s, e, _ in taken[k : k + 3]):
                out.append((start, done))
    return out


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Incompressible tokens behind a sensitive word, clear of the spans already taken."""
    found = candidates(text, taken)
    if not found:
        return []
    edges = [0, *(x for span in found for x in span), len(text)]
    measure = Novelty("\n".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
    worth: dict[str, int] = {}
    out = []
    for a, b in found:
        token = text[a:b]
        if token not in worth:
            worth[token] = measure.added(token)
        if worth[token] - SLACK > novelty * len(token):
            out.append((a, b, "novel"))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def find_secrets(docs: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """Secrets of each document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    spans lists kind:start:end by start, then kind; base_sha256 covers the fixed patterns alone. A null
    or empty text has none; repeated rows and null ids stay; spans of one start go in the order of KINDS, and added
    spans never overlap the fixed ones. Texts count whole, however long, in time linear in them but for the
    candidates, each of which costs a few frames of a kilobyte; an empty table gives no rows; other columns are ignored.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")}
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            found = base + novel_spans(text or "", base, novelty)
            for kind in KINDS:
                rows[f"n_{kind}"].append(sum(k == kind for *_, k in found))
            rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            rows["spans"].append(_joined(found))
        made = [pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in rows.items()]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *rows])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string")
