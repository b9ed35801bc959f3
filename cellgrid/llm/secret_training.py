"""Labelled findings for training the secret classifier: invented secrets and things that look like them.

A finding is (text before, candidate, text after, path, label). All strings come from a seeded
generator; none is a real credential.
"""

from __future__ import annotations

import base64
import json

import numpy as np

FINDINGS = 4_000
SEED = 5

HEX, UPPER, ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
# Common words of code and prose, for invented names and contexts.
WORDS = (
    "the and for with from that this user name value item list index count total data file path home page model view test sample example order customer product price "
    "account invoice payment report table column row cell graph node edge color width height image video audio player button click event handler service client server "
    "request response header body content message error warning info debug level time date year month week day hour minute second first last next previous start stop"
).split()
SECRET_NAMES = "token secret password passwd pwd api_key apikey access_key auth_token client_secret private_key credential bearer signing_key secret_key TOKEN API_KEY".split()
PLAIN_NAMES = "id uuid commit sha sha1 sha256 md5 checksum digest etag hash integrity revision version build ref parent fingerprint cache_key class name label slug url href".split()
SAFE_PATHS = ("test/fixtures/data.json", "docs/example.md", "tests/test_api.py", "package-lock.json", "yarn.lock", "CHANGELOG.md", "samples/readme.txt")
OPEN_PATHS = (".env", "config/settings.yml", "src/app.py", "deploy/prod.tf", "notes.txt", "", "", "", "")


class Maker:
    def __init__(self, seed: int = SEED):
        self.rng = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chars(self, alphabet: str, least: int, most: int | None = None) -> str:
        n = int(self.rng.integers(least, (most or least) + 1))
        return "".join(alphabet[int(k)] for k in self.rng.integers(0, len(alphabet), n))

    def prose(self, least: int = 2, most: int = 9) -> str:
        letters = "etaoinshrdlu"
        words = [self.pick(WORDS) if self.rng.random() < 0.5 else self.chars(letters, 2, 9) for _ in range(int(self.rng.integers(least, most + 1)))]
        return " ".join(words)

    def join(self, glue: str, least: int, most: int) -> str:
        return glue.join(self.pick(WORDS) for _ in range(int(self.rng.integers(least, most + 1))))

    def secret(self) -> str:
        body = (
            lambda: self.chars(HEX, 32, 64), lambda: self.chars(HEX, 40), lambda: self.chars(HEX, 32), lambda: self.chars(ALNUM, 20, 64),
            lambda: base64.b64encode(self.rng.bytes(int(self.rng.integers(16, 64)))).decode(), lambda: "AKIA" + self.chars(UPPER, 16), lambda: "ghp_" + self.chars(ALNUM, 36),
            lambda: "xoxb-" + self.chars("0123456789", 12) + "-" + self.chars(ALNUM, 24), lambda: "sk_live_" + self.chars(ALNUM, 24),
            lambda: self.chars(ALNUM + "!@#%^", 10, 20), lambda: self.chars(HEX.upper(), 40),
            lambda: ".".join((self.encoded(("alg", "typ")), self.encoded(("sub", "name", "iat")), self.chars(ALNUM + "-_", 43))),
            lambda: "eyJ" + base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "n": self.chars(ALNUM, 12)}).encode()).decode()[3:].rstrip("=") + "_" + self.chars(ALNUM, 43),
        )
        return self.pick(body)()

    def encoded(self, keys: tuple[str, ...]) -> str:
        """An object of invented values as a part of a dotted token."""
        return base64.urlsafe_b64encode(json.dumps({k: self.chars(ALNUM, 4, 12) for k in keys}).encode()).decode().rstrip("=")

    def human(self) -> str:
        """A password as people make them: words with digits and marks in or after them."""
        parts = [self.pick(WORDS).capitalize() if self.rng.random() < 0.5 else self.pick(WORDS) for _ in range(int(self.rng.integers(1, 4)))]
        parts.insert(int(self.rng.integers(0, len(parts) + 1)), self.chars("0123456789", 1, 4))
        word = "".join(parts) + self.pick(("", "", "!", "@", "#", "$x"))
        word = word.replace("o", "0", 1).replace("e", "3", 1) if self.rng.random() < 0.4 else word
        return word if len(word) >= 8 else self.human()

    def expression(self) -> str:
        """What a program reads a secret from."""
        name = self.join("_", 1, 3)
        return self.pick((f"os.environ[{name.upper()}]", f"config.get({name})", f"{self.pick(WORDS)}.{name}", f"${{{name.upper()}}}", f"get{name.capitalize()}(x)", f"{{{{{name}}}}}", f"settings.{name.upper()}", f"process.env.{name.upper()}", f"self.{name}", f"request.{name}()"))

    def decoy(self) -> tuple[str, str]:
        """A harmless candidate and a name that goes with it."""
        kinds = (
            lambda: (self.chars(HEX, 40), self.pick(("commit", "sha", "revision", "sha1", "ref", "parent"))),
            lambda: (self.chars(HEX, 64), self.pick(("sha256", "checksum", "digest", "integrity"))),
            lambda: (self.chars(HEX, 32), self.pick(("md5", "etag", "hash", "cache_key", "fingerprint"))),
            lambda: ("-".join(self.chars(HEX, n) for n in (8, 4, 4, 4, 12)), self.pick(("id", "uuid", "guid", "request_id"))),
            lambda: (self.pick(("your_api_key_here", "YOUR-SECRET-TOKEN-HERE", "changeme_changeme_1", "example_password_123", "xxxxxxxxxxxxxxxxxxxxxxxx", "REPLACE_WITH_YOUR_KEY_1", "0000000000000000000000", "<insert_token_here_1>")), self.pick(SECRET_NAMES)),
            lambda: (self.expression(), self.pick(SECRET_NAMES)), lambda: (self.expression(), self.pick(SECRET_NAMES)), lambda: (self.pick(WORDS) + self.pick(("", "s", "ed")) + self.pick(("ing", "ment", "ation", "able")), self.pick(SECRET_NAMES)),
            lambda: (self.join("_", 3, 6), self.pick(PLAIN_NAMES)), lambda: (self.join("-", 3, 6) + "-2020", "slug"), lambda: (self.join("/", 4, 7), "path"),
            lambda: ("".join(w.capitalize() for w in self.join(" ", 3, 6).split()), self.pick(PLAIN_NAMES)), lambda: (self.join("_", 2, 4).upper() + "_" + self.chars("0123456789", 4), "name"),
            lambda: (self.chars("0123456789", 16), self.pick(("card", "account", "phone", "", "", "number"))), lambda: (self.chars("0123456789", 18, 24), self.pick(("id", "order", ""))),
            lambda: ("iVBORw0KGgo" + self.chars(ALNUM + "+/", 60, 200), "data:image/png;base64,"), lambda: (self.join("", 3, 5) + self.chars("0123456789", 1, 3), ""),
            lambda: ("=" * 20 if self.rng.random() < 0.5 else "-" * 30, ""),
        )
        return self.pick(kinds)()

    def finding(self) -> tuple[str, str, str, str, int]:
        label = int(self.rng.random() < 0.5)
        before, after = self.prose(0, 8), self.prose(0, 8)
        human = label and self.rng.random() < 0.12
        if label:
            value, name = self.human() if human else self.secret(), self.pick(SECRET_NAMES)
        else:
            value, name = self.decoy()
        if label and self.rng.random() < 0.08:
            scheme, host = self.pick(("postgres", "mysql", "redis", "amqp", "https", "mongodb")), self.pick(WORDS)
            return f"{before} {scheme}://{self.pick((self.pick(WORDS), ''))}:", self.pick((self.human, lambda: self.chars(ALNUM, 8, 24)))(), f"@{host}/{self.pick(WORDS)} {after}", self.pick(OPEN_PATHS), 1
        roll, quote = self.rng.random(), self.pick(('"', "'", "", '"'))
        if roll < 0.55 or human or not name:
            glue = self.pick((" = ", "=", ": ", " : ", ":")) if name else " "
            before = f"{before} {name}{glue}{quote if name else ''}"
            after = f"{quote if name else ''} {after}"
        elif roll < 0.8 or label:
            before, after = f"{before} {self.pick(('Authorization: Bearer', 'the ' + name + ' is', name, 'export ' + name.upper() + '=')) if label else name} ", f" {after}"
        else:
            before, after = f"{before} {self.prose(1, 2)} ", f" {after}"
        path = self.pick(SAFE_PATHS) if self.rng.random() < (0.08 if label else 0.35) else self.pick(OPEN_PATHS)
        return before, value, after, path, label


def labelled_findings(count: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    maker = Maker(seed)
    return [maker.finding() for _ in range(count)]
