"""The byte-to-character table of byte-level BPE."""


def byte_characters() -> dict[int, str]:
    """The character of each byte: itself if printable, else one from U+0100 on, in order."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in keep else chr(next(spare)) for b in range(256)}


BYTE_CHARS = byte_characters()
