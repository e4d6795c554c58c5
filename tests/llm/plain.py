"""Plain restatements of the contracts of the text scans."""

import hashlib
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def digest(spans):
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    return hashlib.sha256(joined.encode()).hexdigest()


def scan(text, patterns):
    """Counts per kind and the digest of the base spans; patterns are (kind, pattern, test of a match)."""
    spans = [(m.start(), i, k, m.end()) for i, (k, p, good) in enumerate(patterns) for m in re.finditer(p, text or "") if good(m)]
    return (*(sum(s[2] == k for s in spans) for k, _, _ in patterns), digest(spans))


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
]
SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    own, places, labels = words(text), [], set()
    for phrase, label in PHRASES.items():
        sought = phrase.split()
        for i in range(len(own) - len(sought) + 1):
            if own[i:i + len(sought)] == sought:
                places.append(i)
                labels.add(label)
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
