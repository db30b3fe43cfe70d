"""Images as numpy arrays (height, width) or (height, width, 3): PNG bytes, sizes from headers, preparation for a
recogniser, and pages of a PDF. The standard library and numpy suffice; other formats' pixels need a codec.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# An image's longest side, and how much contrast and sharpness are raised.
LONGEST, CONTRAST, SHARPNESS = 3000, 2.0, 2.0
# Shares of red, green and blue in 65536 parts of a grey, and the smoothing kernel that sharpening subtracts.
GREY = (19595, 38470, 7471)
SMOOTH = ((1, 1, 1), (1, 5, 1), (1, 1, 1))
PNG = b"\x89PNG\r\n\x1a\n"
#: Colour types of PNG: channels and mode.
_TYPES = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}


class NotReadable(ValueError):
    pass


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(pixels: np.ndarray) -> bytes:
    """8-bit grey, RGB or RGBA."""
    h, w = pixels.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[pixels.shape[2] if pixels.ndim == 3 else 1]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1).astype(np.uint8)], axis=1)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def from_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit PNG that isn't interlaced; a palette is looked up."""
    if data[:8] != PNG:
        raise NotReadable("no PNG")
    parts: dict[bytes, bytes] = {}
    for kind, body in _chunks(data):
        parts[kind] = parts.get(kind, b"") + body
    w, h, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if bits != 8 or laced:
        raise NotReadable(f"PNG of {bits} bits{', interlaced' * bool(laced)}")
    n = _TYPES[colour][0]
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, 1 + w * n)
    out, above = np.zeros((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for y in range(h):
        out[y] = above = _unfilter(int(raw[y, 0]), raw[y, 1:], above, n)
    out = out.reshape(h, w, n)
    if colour == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[out[:, :, 0]]
    return out[:, :, 0] if n == 1 else out


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
    out, up = [0] * n + line.tolist(), [0] * n + above.tolist()
    for i in range(n, len(out)):
        a, b, c = out[i - n], up[i], up[i - n]
        if kind == 3:
            out[i] = (out[i] + (a + b) // 2) & 255
        else:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out[i] = (out[i] + (a if p <= q and p <= r else b if q <= r else c)) & 255
    return np.array(out[n:], np.uint8)


def size(data: bytes) -> tuple[str, int, int, str]:
    """(format, width, height, mode) from the header alone, of PNG, JPEG, GIF and BMP."""
    if data[:8] == PNG:
        w, h, _, colour = struct.unpack_from(">IIBB", data, 16)
        return "png", w, h, _TYPES[colour][1]
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                break
            marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w, n = struct.unpack_from(">HHB", data, at + 5)
                return "jpeg", w, h, {1: "L", 3: "RGB", 4: "CMYK"}[n]
            at += 2 + length
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", *struct.unpack_from("<HH", data, 6), "P"
    if data[:2] == b"BM":
        w, h, _, bits = struct.unpack_from("<iiHH", data, 18)
        return "bmp", w, abs(h), "P" if bits <= 8 else "RGB"
    raise NotReadable("not a known image")


def rgb(pixels: np.ndarray) -> np.ndarray:
    """Grey and RGB as they are; of others the colours without the opacity."""
    return pixels if pixels.ndim == 2 else pixels[:, :, 0] if pixels.shape[2] == 2 else pixels[:, :, :3]


def grey(pixels: np.ndarray) -> np.ndarray:
    pixels = rgb(pixels)
    return pixels if pixels.ndim == 2 else ((pixels.astype(np.int64) @ np.array(GREY) + 0x8000) >> 16).astype(np.uint8)


def _blend(low: np.ndarray | float, pixels: np.ndarray, share: float) -> np.ndarray:
    return np.clip(low + share * (pixels.astype(np.float64) - low), 0, 255).astype(np.uint8)


def contrast(pixels: np.ndarray, share: float = CONTRAST) -> np.ndarray:
    """Away from the image's mean grey, rounded."""
    return _blend(float(int(pixels.mean() + 0.5)), pixels, share)


def sharpness(pixels: np.ndarray, share: float = SHARPNESS) -> np.ndarray:
    """Away from the smoothed image; the border stays."""
    smooth = pixels.astype(np.float64).copy()
    if min(pixels.shape) > 2:
        kernel, (h, w) = np.array(SMOOTH, float), pixels.shape
        inner = sum(kernel[i, j] * pixels[i : h - 2 + i, j : w - 2 + j] for i in range(3) for j in range(3)) / kernel.sum()
        smooth[1:-1, 1:-1] = np.floor(inner + 0.5)
    return _blend(smooth, pixels, share)


def _weights(old: int, new: int) -> np.ndarray:
    """(new, old) weights of a Lanczos filter of three lobes, stretched where the side shrinks."""
    scale = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new
    x = (np.arange(old)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    across, down = _weights(pixels.shape[1], width), _weights(pixels.shape[0], height)
    out = np.tensordot(down, np.tensordot(across, pixels.astype(np.float64), (1, 1)), (1, 1))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def capped(width: int, height: int, most: int = LONGEST) -> tuple[int, int]:
    if max(width, height) <= most:
        return width, height
    share = most / max(width, height)
    return int(width * share), int(height * share)


def prepare(pixels: np.ndarray, angle: int = 0, most: int = LONGEST) -> np.ndarray:
    """An image for a recogniser: its longer side at most `most`, turned by -angle (a multiple of 90, as the recogniser's
    orientation model reports it), grey, with more contrast and sharpness."""
    h, w = pixels.shape[:2]
    if (w, h) != capped(w, h, most):
        pixels = resize(pixels, *capped(w, h, most))
    if angle % 90:
        raise ValueError("angle must be a multiple of 90")
    return sharpness(contrast(grey(np.rot90(rgb(pixels), -angle // 90))))


def _image_object(data: bytes) -> tuple[bytes, bytes]:
    """Dictionary and stream of a PDF image: a JPEG's bytes as they are, else deflated pixels."""
    kind, w, h, mode = size(data)
    if kind == "jpeg":
        space, body, name = {"L": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK"}[mode], data, "DCTDecode"
    else:
        pixels = rgb(from_png(data))
        space, body, name = "DeviceGray" if pixels.ndim == 2 else "DeviceRGB", zlib.compress(np.ascontiguousarray(pixels).tobytes()), "FlateDecode"
    return f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /{space} /BitsPerComponent 8 /Filter /{name} /Length {len(body)} >>".encode(), body


def pdf_of_images(pages: list[tuple[bytes, float, float, tuple[float, float, float, float]]]) -> bytes:
    """A PDF with a page for each (image, width, height, box) in points, the box from the upper left corner."""
    objects: list[bytes] = [b"", b""]
    kids = []
    for data, width, height, (x0, y0, x1, y1) in pages:
        head, body = _image_object(data)
        draw = f"q {x1 - x0:.4f} 0 0 {y1 - y0:.4f} {x0:.4f} {height - y1:.4f} cm /Im Do Q".encode()
        n = len(objects)
        objects += [
            head + b"\nstream\n" + body + b"\nendstream",
            b"<< /Length %d >>\nstream\n" % len(draw) + draw + b"\nendstream",
            f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:.4f} {height:.4f}] /Resources << /XObject << /Im {n + 1} 0 R >> >> /Contents {n + 2} 0 R >>".encode(),
        ]
        kids.append(f"{n + 3} 0 R")
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    parts, at, length = [b"%PDF-1.4\n"], [], 9
    for i, body in enumerate(objects, 1):
        at.append(length)
        parts.append(b"%d 0 obj\n" % i + body + b"\nendobj\n")
        length += len(parts[-1])
    table = b"".join(b"%010d 00000 n \n" % x for x in at)
    end = b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, length)
    return b"".join([*parts, b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1), table, end])
