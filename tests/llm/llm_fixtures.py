import random

SYLLABLES = "an the er on in at ing ha re st ou nd wh ea ti es or le ve mo".split()


def prose(seed: int, words: int) -> str:
    """Invented prose: words of one to four syllables, a line break now and then."""
    r = random.Random(seed)
    made = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words)]
    return "".join(w + (".\n" if r.random() < 0.08 else " ") for w in made).strip()
