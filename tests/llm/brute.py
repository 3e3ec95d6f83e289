"""Plain versions of what the contracts fix, for comparison on small inputs."""

import hashlib
import re

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return [int(c) for c in text if c in "0123456789"]


def luhn(text):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits(text)))) % 10 == 0


def written(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


def pii(text):
    text = text or ""
    found = [(0, m) for m in EMAIL.finditer(text)]
    found += [(1, m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, m) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(m[0])]
    found += [(3, m) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def secrets(text):
    text = text or ""
    found = [(0, m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(2, m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], s[0]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
