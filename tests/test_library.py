"""Worlds and assets, by method and over HTTP."""

import json
import struct
import threading
import urllib.error
import urllib.request

import pytest

from weftline.plans.http_api import serve
from weftline.plans.library import DEFAULTS, Library, LibraryError, font_full_name

PNG = b"\x89PNG\r\n\x1a\ntest"


def font(names):
    """A font file of a name table alone: (platform, name id, text) records."""
    data = [t.encode("utf-16-be" if p == 3 else "mac-roman") for p, _, t in names]
    records, at = b"", 0
    for (p, n, _), d in zip(names, data):
        records += struct.pack(">HHHHHH", p, 1, 0, n, len(d), at)
        at += len(d)
    table = struct.pack(">HHH", 0, len(names), 6 + len(records)) + records + b"".join(data)
    return struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"name" + struct.pack(">III", 0, 28, len(table)) + table


def test_font_names():
    assert font_full_name(font([(1, 4, "Mac Name"), (3, 4, " Full  Name "), (3, 1, "Family")])) == "Full Name"
    assert font_full_name(font([(1, 4, "Only")])) == "Only"
    for bad in (b"", b"x" * 40, font([(3, 1, "Family")])):
        with pytest.raises(LibraryError, match="FONT_NAME_UNREADABLE"):
            font_full_name(bad)


def test_library(spark, tmp_path):
    library = Library(spark, str(tmp_path))
    first = library.add("  The   Vale ")
    with pytest.raises(LibraryError, match="WORLD_NAME_DUPLICATE"):
        library.add("the vale")
    image = library.upload("image", PNG, "My  pic.PNG")
    with pytest.raises(LibraryError, match="IMAGE_SIGNATURE_INVALID"):
        library.upload("image", b"no", "a.png")
    assert library.save(first, "Vale", background_asset_id=image)["background_asset_id"] == image
    with pytest.raises(LibraryError, match="FONT_ASSET_NOT_FOUND"):
        library.save(first, "Vale", font_asset_id=image)
    assert library.delete_impact(image)["affected_worlds"] == 1
    library.delete(image)
    assert library.detail(first)["background_asset_id"] == DEFAULTS["image"]
    with pytest.raises(LibraryError, match="DEFAULT_ASSET_DELETE_BLOCKED"):
        library.delete(DEFAULTS["font"])


def test_http(spark, tmp_path):
    library = Library(spark, str(tmp_path))
    world = library.add("One")
    server = serve(library)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None, **headers):
        asked = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data=body, method=method, headers=headers)
        try:
            with urllib.request.urlopen(asked) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    try:
        assert json.loads(ask("GET", "/api/health")[1]) == {"status": "ok"}
        assert [w["title"] for w in json.loads(ask("GET", "/api/worlds")[1])["worlds"]] == ["One"]
        code, body = ask("POST", "/api/user-assets/images", PNG, **{"X-Filename": "a.png"})
        key = json.loads(body)["asset_id"]
        assert ask("GET", f"/api/user-assets/{key}") == (200, PNG)
        assert ask("PATCH", f"/api/worlds/{world}/detail", json.dumps({"display_name": " "}).encode())[0] == 400
        assert json.loads(ask("PATCH", f"/api/worlds/{world}/detail", json.dumps({"display_name": "Two", "background_asset_id": key}).encode())[1])["title"] == "Two"
        assert ask("GET", "/api/worlds/none/detail")[0] == 404 and ask("GET", "/api/../x")[0] == 404
        assert json.loads(ask("DELETE", f"/api/user-assets/{key}")[1])["affected_worlds"] == 1
    finally:
        server.shutdown()
