"""Held-out texts with marked spans, made by other templates than those the operators are fitted on."""

import random
import string

FIRST = "Anna Tom Maria Ahmed Ingrid Paolo Yuki Sven Lucie Omar".split()
NOUNS = "meeting garden report ticket kitchen station invoice project lesson market bridge letter window system journey budget".split()
VERBS = "started moved arrived failed improved changed closed finished waited returned".split()


def sentence(rng):
    return f"{rng.choice(['The', 'Our', 'A', 'Last', 'This'])} {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(['before', 'after', 'near', 'without'])} the {rng.choice(NOUNS)}. "


def digits(rng, k):
    return "".join(rng.choice("0123456789") for _ in range(k))


def personal(rng):
    """(before, span, after) of something personal beyond the fixed patterns."""
    d = lambda k: digits(rng, k)
    name = rng.choice(FIRST)
    hexa = lambda up: "".join(rng.choice("0123456789ABCDEF" if up else "0123456789abcdef") for _ in range(2))
    return rng.choice([
        lambda: (f"You can phone {name} on ", f"{d(3)}-{d(3)}-{d(4)}", " after six. "),
        lambda: ("Tel ", f"({d(3)}) {d(3)}-{d(4)}", ", office hours only. "),
        lambda: (f"{name}'s mobile number is ", f"{d(3)} {d(3)} {d(4)}", ". "),
        lambda: (f"My social security number is ", f"{d(3)}-{d(2)}-{d(4)}", " as you asked. "),
        lambda: ("SSN: ", f"{d(3)}-{d(2)}-{d(4)}", "\n"),
        lambda: ("Please pay to IBAN ", f"{rng.choice(['DE', 'NL', 'IT'])}{d(2)} " + " ".join(d(4) for _ in range(4)), ", thank you. "),
        lambda: ("The account is ", f"{rng.choice(['FR', 'ES'])}{d(2)}" + "".join(" " + d(4) for _ in range(5)), ". "),
        lambda: (f"Write to ", f"{name.lower()}.{rng.choice(NOUNS)} [at] {rng.choice(NOUNS)}.org", " for details. "),
        lambda: ("mail me: ", f"{name.lower()}{d(2)} (at) {rng.choice(NOUNS)} (dot) net", ". "),
        lambda: ("The MAC address of the laptop was ", ":".join(hexa(False) for _ in range(6)), ". "),
        lambda: ("device ", "-".join(hexa(True) for _ in range(6)), " went offline. "),
        lambda: ("Her passport number is ", d(9), ". "),
        lambda: ("national id ", d(rng.choice([8, 10, 11])), ", valid until May. "),
    ])()


def harmless(rng):
    d = lambda k: digits(rng, k)
    return rng.choice([
        lambda: f"Order {d(8)} shipped on {d(4)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}. ", lambda: f"It cost ${d(3)},{d(3)}.{d(2)} in all. ", lambda: f"See page {d(3)} of volume {d(2)}. ", lambda: f"The total was {d(9)} rows. ",
        lambda: f"Version {d(1)}.{d(2)}.{d(3)} came out at {d(2)}:{d(2)}. ", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)} is out of print. ", lambda: f"Part {d(3)}-{d(2)}-{d(4)} is in stock. ", lambda: f"About {d(3)} {d(3)} {d(3)} people live there. ",
    ])()


def secret(rng):
    """(before, span, after) of a secret."""
    alnum = string.ascii_letters + string.digits
    run = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    return rng.choice([
        lambda: ("export AWS_SECRET_ACCESS_KEY=", run(alnum + "+/", 40, 40), "\n"),
        lambda: ('{"api_key": "', run(alnum, 32, 40), '"} '),
        lambda: ("Authorization: Bearer ", "eyJ" + run(alnum, 20, 30) + "." + run(alnum, 30, 40) + "." + run(alnum, 30, 43), "\n"),
        lambda: ("the token ", "ghp_" + run(alnum, 36, 36), " was revoked. "),
        lambda: ("set STRIPE to ", "sk_live_" + run(alnum, 24, 24), ". "),
        lambda: ("commit key ", run("0123456789abcdef", 40, 40), " leaked. "),
        lambda: ("client_secret: ", run(alnum, 24, 36), "\n"),
        lambda: ("passphrase = '", run(string.ascii_letters, 4, 6) + run(string.digits, 3, 4) + run(string.ascii_letters, 3, 5), "'\n"),
        lambda: ("pwd: ", run(alnum, 10, 14), "\n"),
        lambda: ("slack hook ", "xoxb-" + digits(rng, 12) + "-" + run(alnum, 24, 24), " again. "),
        lambda: ("AKIA example: ", "AKIA" + run(string.ascii_uppercase + string.digits, 16, 16), ", gone. "),
    ])()


def plain_code(rng):
    d = lambda k: digits(rng, k)
    return rng.choice([
        lambda: f"for i in range({d(2)}): total += rows[i]\n", lambda: f"version = {d(1)}.{d(2)}.{d(1)}\n", lambda: f"Open https://{rng.choice(NOUNS)}.example.org/{rng.choice(NOUNS)}/{d(4)} now. ", lambda: "Enter your password and press return. ",
        lambda: "The secret of the garden is water. ", lambda: f"def {rng.choice(NOUNS)}_{rng.choice(VERBS)}(x, y): return x\n", lambda: f"Call {d(3)}-{d(4)} or mail {rng.choice(FIRST).lower()}@{rng.choice(NOUNS)}.com. ", lambda: f"On {d(4)}-{d(2)}-{d(2)} at {d(2)}:{d(2)}:{d(2)} it failed. ",
        lambda: "A token of thanks for internationalization and counterrevolutionaries. ", lambda: f"invoice_{d(6)}.pdf was sent. ",
    ])()


def texts(kind, other, n, seed):
    """n texts with the places of their marked spans."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 5)):
            text += sentence(rng)
            if rng.random() < 0.5:
                before, span, after = kind(rng)
                spans.append((len(text) + len(before), len(text) + len(before) + len(span)))
                text += before + span + after
            else:
                text += other(rng)
        out.append((text + sentence(rng), spans))
    return out
