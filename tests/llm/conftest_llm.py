import random

WORDS = "the of and to in is that was with be on for as by it at from or an are this which one had not but what all were when we there can said use each".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") * rng.randint(0, 2)) for _ in range(n)) + "."
