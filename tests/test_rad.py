import io
import random

import pytest

from cytoplan.sources import rad


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    chunks = [[(rng.randrange(4**16), rng.randrange(4**12), refs := sorted(rng.sample(range(50), rng.randint(0, 3))), [rng.random() < 0.5 for _ in refs]) for _ in range(rng.randint(0, 9))] for _ in range(11)]
    with open(tmp_path / "map.rad", "wb") as f:
        rad.write_plain(f, [f"t{i}" for i in range(50)], chunks, 16, 12)
    for per_task in (1, 3, 64):
        rows = rad.read(spark, str(tmp_path / "map.rad"), per_task).select("bc", "umi", "refs", "dirs", "sample", "pos").collect()
        assert sorted((r.bc, r.umi, r.refs, r.dirs) for r in rows) == sorted(x for c in chunks for x in c)
        assert all(r["sample"] is None and r.pos is None for r in rows)


def test_prelude_and_damage(tmp_path):
    f = io.BytesIO()
    rad.write_plain(f, ["a", "b"], [], 4, 4)
    p = rad.read_prelude(io.BytesIO(f.getvalue()))
    assert (p.references, p.chunks, p.values, p.kind()) == (["a", "b"], 0, {"cblen": 4, "ulen": 4}, "plain")
    with pytest.raises(ValueError):
        rad.read_prelude(io.BytesIO(f.getvalue()[:-3]))
    tags = lambda *names: [(n, (rad.U32,)) for n in names]
    kinds = [({"num_barcodes": 2}, ("pos",), "multi-barcode"), ({}, ("as", "start", "end", "pos"), "long-read"), ({}, ("pos",), "positions"), ({}, ("type", "start_pos", "frag_len"), "fragments")]
    for values, names, kind in kinds:
        assert rad.Prelude(False, [], 0, [], [], tags(*names), values).kind() == kind
