"""Made-up findings with known labels, to train and test the secret scan with.

A finding is a value in some spelling, mostly under a name. Secrets are random
values under names of credentials, with a provider's prefix, or random mixed
letters in prose. Look-alikes are digests and identifiers under neutral names,
placeholders and plain words under names of credentials, and hosts, paths, versions
and names in prose. Names and shapes marked as held out are made for tests only.
"""

from __future__ import annotations

import random
import string
import uuid

HEX, LOWER, UPPER, DIGITS = "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase, string.digits
MIXED = string.ascii_letters + DIGITS
MOST = MIXED + "_-"

CREDENTIAL_NAMES = """token secret password passwd pwd pass api_key apikey access_key secret_key auth_token client_secret
credentials private_token session_secret refresh_token app_secret access_token auth_key passwort kennwort zugangscode
mot_de_passe jeton contraseña clave""".split()
HELD_CREDENTIAL_NAMES = "bearer_token signing_secret db_password encryption_key master_key webhook_token passphrase credencial motdepasse".split()
NEUTRAL_NAMES = """commit sha256 md5 checksum digest revision etag uuid build version id ref sha1 hash object_id request_id
trace parent tree image file path host url user name date release package""".split()
HELD_NEUTRAL_NAMES = "fingerprint_sha256 blob_id commit_hash md5sum trace_id image_digest build_version".split()
OWNERS = "aws stripe db github slack my service prod mail storage payment admin".split()

SPELLINGS = (
    '{n} = "{v}"', "{n}: {v}", "{n}={v}", '"{n}": "{v}"', "export {n}={v}", "--{n} {v}", "--{n}={v}",
    "https://www.{w}.com/cb?{n}={v}", "{n} '{v}'", "{n} {v}", "{n} := '{v}'", "<{n}>{v}</{n}>", "{n} is {v}",
)
HELD_SPELLINGS = ("{n} => '{v}'", "set {n} to {v} now", "{n}:{v}", "[{n}='{v}']")
PLAIN_SPELLINGS = ("{v}", "({v})", "use {v} here", '"{v}"', "see {v}.")

#: Paths say nothing about what is in them: they are drawn apart from the labels.
PATHS = "config/prod.env deploy/settings.py app/secrets.yml .env infra/main.tf tests/fixtures/data.json docs/readme.md examples/sample.py package-lock.json CHANGELOG.md".split()


def drawn(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choices(alphabet, k=n))


def _sized(alphabet: str, *sizes: int):
    return lambda rng, words: drawn(rng, alphabet, rng.choice(sizes))


def _password(rng: random.Random, words: list[str]) -> str:
    return drawn(rng, MOST + ".~", rng.randrange(16, 26))


def _base64(rng: random.Random, words: list[str]) -> str:
    return drawn(rng, MIXED + "+/", rng.choice((24, 40, 44, 64, 86))) + "=" * rng.randrange(3)


def _prefixed(rng: random.Random, words: list[str]) -> str:
    if rng.random() < 0.15:
        return f"https://hooks.{rng.choice(words).lower()}.com/services/" + "/".join(drawn(rng, UPPER + DIGITS, 9) for _ in "ab") + "/" + drawn(rng, MIXED, 24)
    prefix, alphabet, n = rng.choice(
        (
            ("AKIA", UPPER + DIGITS, 16), ("ASIA", UPPER + DIGITS, 16), ("ghp_", MIXED, 36), ("gho_", MIXED, 36),
            ("glpat-", MIXED, 20), ("sk_live_", MIXED, 24), ("rk_live_", MIXED, 24), ("xoxb-", DIGITS + "-" + MIXED, 40),
            ("AIza", MOST, 35),
        )
    )
    return prefix + drawn(rng, HEX if alphabet == MIXED and rng.random() < 0.3 else alphabet, n)


def _short(rng: random.Random, words: list[str]) -> str:
    """A password as people and managers make them: 8 to 20 characters, half of them with punctuation."""
    marks = rng.choice(("", "!#$%^&*@?"))
    return drawn(rng, MIXED + 2 * marks, rng.randrange(8, 21))


def _held_prefixed(rng: random.Random, words: list[str]) -> str:
    kind = rng.randrange(4)
    if kind == 0:
        return "SG." + drawn(rng, MOST, 22) + "." + drawn(rng, MOST, 43)
    if kind == 1:
        return "https://hooks.chat.example/services/T" + drawn(rng, UPPER + DIGITS, 8) + "/B" + drawn(rng, UPPER + DIGITS, 8) + "/" + drawn(rng, MIXED, 24)
    return rng.choice((("sk-", 48), ("npm_", 36), ("hf_", 34)))[0] + drawn(rng, MIXED, 40)


def _plain_word(rng: random.Random, words: list[str]) -> str:
    """Words where a value might stand: long ones, or joined."""
    long = [w for w in words if len(w) >= 8]
    word = rng.choice(long) if long and rng.random() < 0.6 else rng.choice("_-.").join(rng.choices(words, k=2)).ljust(8, "e")
    return rng.choice((word, word.lower(), word.title(), word.upper()))


def _signed(rng: random.Random, words: list[str]) -> str:
    return "eyJ" + ".".join(drawn(rng, MOST, n) for n in (20, 60, 43))


def _uuid(rng: random.Random, words: list[str]) -> str:
    return str(uuid.UUID(int=rng.getrandbits(128), version=4))


def _host(rng: random.Random, words: list[str]) -> str:
    return f"{rng.choice(('mail', 'www', 'cdn', 'node', rng.choice(words)))}{rng.randrange(100)}.{rng.choice(words)}.{rng.choice(('com', 'org', 'example.com', 'net'))}".lower()


def _path(rng: random.Random, words: list[str]) -> str:
    return "/".join(["", *rng.choices(words, k=rng.randrange(2, 5))]) + f"{rng.randrange(100)}.{rng.choice(('so', 'html', 'png', 'txt'))}"


def _version(rng: random.Random, words: list[str]) -> str:
    return ".".join(str(rng.randrange(30)) for _ in range(3)) + f"-{rng.choice(('beta', 'rc', 'build', 'snapshot'))}.{rng.randrange(10**6)}+{rng.choice(words)}"


def _moment(rng: random.Random, words: list[str]) -> str:
    return f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}T{rng.randrange(24):02}-{rng.randrange(60):02}-00Z"


def _joined(rng: random.Random, words: list[str]) -> str:
    parts = rng.choices(words, k=rng.randrange(3, 6))
    name = rng.choice(("_", "-", ".")).join(parts) if rng.random() < 0.7 else "".join(map(str.title, parts))
    return name.ljust(14, "x") + f"{rng.choice(('_', '-', ''))}{rng.randrange(1, 1000):02}"


def _serial(rng: random.Random, words: list[str]) -> str:
    return f"{rng.choice(words).upper()[:4]}-20{rng.randrange(10, 30)}-{rng.randrange(10**6):06}-{rng.choice('ABC')}{rng.randrange(10)}"


def _placeholder(rng: random.Random, words: list[str]) -> str:
    return rng.choice(
        (
            f"your_{rng.choice(words)}_{rng.choice(('key', 'token', 'secret'))}_here_{rng.randrange(1, 100)}",
            rng.choice("xX0a") * rng.randrange(16, 40) + str(rng.randrange(1, 10)) + "a",
            f"example-{rng.choice(words)}-{rng.randrange(100, 10**5)}",
            f"changeme-{rng.choice(words)}-changeme{rng.randrange(10)}",
            "1234567890abcdef" * rng.randrange(1, 3),
            f"process.env.{rng.choice(words).upper()}_KEY{rng.randrange(10)}",
            f"config.{rng.choice(words)}.{rng.choice(words)}{rng.randrange(10)}.value",
            f"${{{rng.choice(words).upper()}_PASSWORD}}",
            rng.choice("*x.#") * rng.randrange(8, 20),
            f"%({rng.choice(words).lower()}_token)s",
            f"{{{{{rng.choice(words).lower()}_secret}}}}",
        )
    )


RANDOM = (_sized(HEX, 32, 40, 48, 64), _sized(MIXED, 20, 24, 32, 40, 64), _sized(MOST, 22, 43), _sized(UPPER + "234567", 16, 26, 32), _password, _base64, _short, _short, _sized(LOWER + UPPER, 20, 24, 32, 40))
HELD_RANDOM = (_sized(HEX, 36, 56), _sized(MIXED, 28, 36, 48), _sized(LOWER + DIGITS, 25, 34), _sized(MOST + ".", 30), _short, _sized(LOWER + UPPER, 28, 36))
DIGESTS = (_sized(HEX, 32, 40, 64, 128), _uuid, _base64, _sized(HEX, 40))
HELD_DIGESTS = (_sized(HEX, 56, 96), _uuid)
WORDED = (_host, _path, _version, _moment, _joined, _serial)


def spelled(rng: random.Random, name: str) -> str:
    """A name as programs write it: with an owner, in capitals, joined in several ways."""
    parts = name.split("_")
    if rng.random() < 0.3:
        parts = [rng.choice(OWNERS), *parts]
    style = rng.randrange(4)
    if style == 0:
        return "_".join(parts).upper()
    if style == 1:
        return parts[0] + "".join(map(str.title, parts[1:]))
    return ("_", "-")[style - 2].join(parts)


def made_finding(rng: random.Random, words: list[str], held: bool = False) -> tuple[str, int, int, str | None, bool]:
    """(text, start, end, path, label) of one finding: where its value stands, and if it is a secret."""
    kind = rng.choices(("named", "plain", "digest", "placeholder", "worded", "named_words", "plain_words"), (40, 10, 20, 10, 10, 5, 12))[0]
    spellings = HELD_SPELLINGS if held else SPELLINGS
    label, name = kind in ("named", "plain"), ""
    if kind == "named":
        name = rng.choice(HELD_CREDENTIAL_NAMES if held else CREDENTIAL_NAMES)
        make = rng.choice((*(HELD_RANDOM if held else RANDOM), _held_prefixed if held else _prefixed, _signed))
    elif kind == "plain":
        prefixed = _held_prefixed if held else _prefixed
        make = rng.choice((prefixed, prefixed, _signed, _sized(MIXED, 32, 40, 44)))
    elif kind == "digest":
        name = rng.choice(HELD_NEUTRAL_NAMES if held else NEUTRAL_NAMES)
        make = rng.choice(HELD_DIGESTS if held else DIGESTS)
    elif kind == "placeholder":
        name, make = rng.choice(HELD_CREDENTIAL_NAMES if held else CREDENTIAL_NAMES), _placeholder
    elif kind == "plain_words":
        name, make = rng.choice(HELD_CREDENTIAL_NAMES if held else CREDENTIAL_NAMES), _plain_word
    else:
        name, make = rng.choice(HELD_NEUTRAL_NAMES if held else NEUTRAL_NAMES), rng.choice(WORDED)
    value = make(rng, words)
    bare = kind in ("plain", "worded") or kind == "digest" and rng.random() < 0.3
    form = rng.choice(PLAIN_SPELLINGS if bare else spellings)
    before, after = form.split("{v}")
    fill = {"n": spelled(rng, name) if name else "", "w": rng.choice(words).lower()}
    before, after = before.format(**fill), after.format(**fill)
    path = rng.choices((None, rng.choice(PATHS)), (1, 1))[0]
    return before + value + after, len(before), len(before) + len(value), path, label
