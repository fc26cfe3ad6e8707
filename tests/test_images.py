import os
import struct
import zlib


from agrolith.operators.profile import class_summary, file_summary, image_folders
from agrolith.sources.images import decode_images, labelled_images, list_images, preprocess


def _png(path, w=6, h=4, rgb=(255, 0, 0)):
    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))

    def chunk(t, data):
        return struct.pack(">I", len(data)) + t + data + struct.pack(">I", zlib.crc32(t + data) & 0xFFFFFFFF)
    ihdr = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def _tree(root):
    for cls, rgb in [("healthy", (0, 200, 0)), ("blight", (200, 0, 0))]:
        os.makedirs(f"{root}/{cls}")
        _png(f"{root}/{cls}/a.png", rgb=rgb)
        _png(f"{root}/{cls}/b.PNG", rgb=rgb)
    with open(f"{root}/blight/broken.png", "wb") as f:
        f.write(b"not an image")
    with open(f"{root}/notes.txt", "w") as f:
        f.write("x")


def test_listing_labels_and_summaries(spark, tmpdir_path):
    root = f"{tmpdir_path}/imgs"
    _tree(root)
    lst = list_images(spark, root)
    assert lst.count() == 5  # .PNG listed in any case, .txt not
    fs = {r.extension: r.files for r in file_summary(lst).collect()}
    assert fs == {".png": 5}
    cs = {r["class"]: (r.images, r.class_based) for r in class_summary(lst).collect()}
    assert cs == {"healthy": (2, True), "blight": (3, True)}
    assert image_folders(lst).count() == 2
    lab = {(r["class"], r.label) for r in labelled_images(spark, root).collect()}
    assert lab == {("blight", 0), ("healthy", 1)}


def test_flat_folder_gets_label_zero(spark, tmpdir_path):
    root = f"{tmpdir_path}/flat"
    os.makedirs(root)
    _png(f"{root}/one.png")
    rows = labelled_images(spark, root).collect()
    assert [(r["class"], r.label) for r in rows] == [("", 0)]


def test_decode_bgr_invalid_flag_and_preprocess(spark, tmpdir_path):
    root = f"{tmpdir_path}/imgs"
    _tree(root)
    dec = decode_images(spark, root)
    rows = {os.path.basename(r.path) + r["class"]: r for r in dec.collect()}
    assert rows["broken.pngblight"].valid is False
    ok = rows["a.pngblight"]
    assert (ok.width, ok.height, ok.channels) == (6, 4, 3)
    assert bytes(ok.data[:3]) == bytes([0, 0, 200])  # stored as BGR
    t = {r.path.split("/")[-1] + r.path.split("/")[-2]: r for r in preprocess(dec, 8).collect()}
    assert t["broken.pngblight"].tensor is None
    red = t["a.pngblight"].tensor
    assert len(red) == 3 * 8 * 8
    assert abs(red[0] - (200 / 255 - 0.485) / 0.229) < 1e-5  # R channel first


def test_shrinking_averages_every_source_pixel():
    """Halving a black and white chessboard gives grey; a flat image stays flat at any size."""
    import numpy as np

    from agrolith.sources.images import MEAN_RGB, STD_RGB, _resize_norm, _weights
    for n, size in ((256, 128), (300, 128), (6, 128), (128, 128)):
        w = _weights(n, size)
        assert np.allclose(w.sum(axis=1), 1) and (w.sum(axis=0) > 0).all() if n >= size else True
    assert np.allclose(_weights(128, 128), np.eye(128))
    board = (np.indices((256, 256)).sum(axis=0) % 2 * 255).astype(np.uint8)
    t = _resize_norm(board.tobytes(), 256, 256, 1, 128).reshape(3, 128, 128)
    grey = (t * np.array(STD_RGB, np.float32)[:, None, None] + np.array(MEAN_RGB, np.float32)[:, None, None]) * 255
    inner = grey[:, 1:-1, 1:-1]  # at the rim the filter has fewer samples, not as many black as white
    assert abs(inner - 127.5).max() <= 0.51 and abs(grey - 127.5).max() < 4
    flat = np.full((200, 300, 3), 77, np.uint8)
    t = _resize_norm(flat.tobytes(), 200, 300, 3, 64).reshape(3, -1)
    assert all(len(set(c.tolist())) == 1 for c in t)


def test_empty_class_folder_keeps_its_label(spark, tmpdir_path):
    import os

    from agrolith.sources.images import labelled_images
    for d, names in (("a", []), ("b", ["x.png", "y.PNG"]), ("c", ["z.jpg", "deep/q.png"])):
        for n in names or [None]:
            os.makedirs(os.path.join(tmpdir_path, "set", d, os.path.dirname(n or "")), exist_ok=True)
            if n:
                open(os.path.join(tmpdir_path, "set", d, n), "wb").write(b"1")
    got = sorted((r["class"], r.label, r.path.rsplit("/", 1)[1]) for r in labelled_images(spark, f"{tmpdir_path}/set").collect())
    assert got == [("b", 1, "x.png"), ("c", 2, "z.jpg")]
