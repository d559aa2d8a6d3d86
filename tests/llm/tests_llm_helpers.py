"""Small helpers of the operator tests."""

WORDS = "amber brisk cedar delta ember fjord gloom hazel ivory jolly karma lemon mango noble ocean pearl quiet river stone tiger".split()


def prose(seed: int, n: int) -> str:
    state, found = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        found.append(WORDS[(state >> 8) % len(WORDS)] + str((state >> 16) % 97))
    return " ".join(found)


def rows_of(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]
