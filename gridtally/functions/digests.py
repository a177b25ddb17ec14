"""SHA-256 whose state can be handed from task to task, by OpenSSL's library that Python's hashlib uses."""

from __future__ import annotations

import ctypes

#: Bytes of OpenSSL's SHA256_CTX: eight words, the length in bits, the open block, its fill and the digest's length.
STATE_BYTES = 112


def _library() -> ctypes.CDLL | None:
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        return lib if all(hasattr(lib, f"SHA256_{n}") for n in ("Init", "Update", "Final")) else None
    except (ImportError, OSError):
        return None


def resumable() -> bool:
    """Whether this Python can hand over the state."""
    return _library() is not None


class Sha256:
    """A running digest that starts from ``state``, as an earlier one left it."""

    def __init__(self, state: bytes | None = None):
        self.lib, self.buffer = _library(), ctypes.create_string_buffer(state or b"", STATE_BYTES)
        if state is None:
            self.lib.SHA256_Init(self.buffer)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.buffer, data, ctypes.c_size_t(len(data)))

    @property
    def state(self) -> bytes:
        return self.buffer.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.state, STATE_BYTES))
        return out.raw.hex()
