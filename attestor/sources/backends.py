"""Optional providers of PDF pages, images and OCR.

None ships with the engine: a provider is a function registered by kind, and
rows that need a missing one carry an error instead of a result.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np

from attestor.functions import images

PROVIDERS: dict[str, Callable] = {}
#: A token for each registration; what a worker process knows of a provider is kept by it.
TOKENS: dict[Callable, str] = {}
_KNOWN: dict[str, tuple[frozenset[str] | None, str | None]] = {}
#: What stands for a page that can't be drawn: 100 by 100, light red.
PLACEHOLDER = (100, 100, 3, bytes((200, 200, 255)) * 10000, 0.0, 0.0)


def register(kind: str, provider: Callable) -> None:
    """kind: "pdf" (bytes, dpi) -> pages (an exception in place of a page that can't be drawn), "image" bytes -> page, "count" bytes of
    a PDF -> number of pages, "words" bytes of a PDF -> (page, x0, y0, x1, y1,
    text, block, line, word_no), "ocr" (array, language code, page mode) -> (text,
    confidence), "ocr_languages" () -> language packs, which raises where the engine
    is missing.  A page is (h, w, c, data, native_w, native_h)."""
    PROVIDERS[kind] = provider


class Engine:
    """The registered OCR engine, as tasks carry it.

    Whether it is there, and with which language packs, is found out once in
    a worker process, however many tasks and images it has.
    """

    def __init__(self, providers: dict[str, Callable]):
        self.read, self.languages = providers.get("ocr"), providers.get("ocr_languages")
        self.token = TOKENS.setdefault(self.languages, uuid.uuid4().hex) if self.languages else None

    def known(self) -> tuple[frozenset[str] | None, str | None]:
        """The installed packs (None: not known) and why the engine is missing, if it is."""
        if self.read is None:
            return None, "no ocr backend is available"
        if self.languages is None:
            return None, None
        if self.token not in _KNOWN:
            try:
                _KNOWN[self.token] = frozenset(self.languages()), None
            except Exception as e:
                _KNOWN[self.token] = None, f"no ocr backend is available: {e}"
        return _KNOWN[self.token]


def pages_of(name: str, content: bytes, dpi: int, providers: dict[str, Callable]) -> Iterator[tuple]:
    """(page_in_file, page) of one file; raises where nothing can read it."""
    extension = name.rsplit(".", 1)[-1].lower()
    if extension == "pdf":
        pages = (PLACEHOLDER if isinstance(page, Exception) else page for page in provider("pdf", providers)(content, dpi))
    elif extension in ("jpg", "jpeg", "png"):
        pages = [provider("image", providers)(content)]
    else:
        raise ValueError(f"unsupported file type: {extension}")
    yield from enumerate(pages, 1)


def count_of(name: str, content: bytes, providers: dict[str, Callable]) -> int:
    """Pages of one file, counted without drawing them where a provider can."""
    if name.lower().endswith(".pdf") and "count" in providers:
        return providers["count"](content)
    return sum(1 for _ in pages_of(name, content, 72, providers))


def _png(content: bytes) -> tuple:
    if not content.startswith(b"\x89PNG"):
        raise RuntimeError("no image backend is available")
    x = images.from_png(content)
    return x.shape[0], x.shape[1], 1 if x.ndim == 2 else 3, np.ascontiguousarray(x).tobytes(), float(x.shape[1]), float(x.shape[0])


def provider(kind: str, providers: dict[str, Callable]) -> Callable:
    if kind in providers:
        return providers[kind]
    if kind == "image":
        try:
            from PIL import Image, ImageOps
        except ImportError:
            return _png  # the only kind that needs no library

        def decode(content: bytes) -> tuple:
            image = ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB")
            return image.height, image.width, 3, image.tobytes("raw", "BGR"), float(image.width), float(image.height)

        return decode
    raise RuntimeError(f"no {kind} backend is available")
