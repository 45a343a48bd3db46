"""What runs on executors needs no copy of the package there."""

import os
import subprocess
import sys

from pyspark import cloudpickle

from ranklume.llm import decontaminate, fingerprint, license_scan, quality, simhash, substring_dedup, toxicity


def test_functions_travel_by_value(tmp_path):
    found = decontaminate.index([(1, "alpha beta gamma delta epsilon? zeta eta theta.")])
    model = toxicity.Model({"bad": 3.0}, -0.1, 1.0, 0.1, (0.0, 1.0, 0.0))
    calls = [
        (license_scan.detections, (b"licensed under the mit license",)),
        (simhash.simhash, ("a b c d",)),
        (simhash.Minima(0), (simhash.np.arange(9, dtype="u8") << simhash.np.uint64(40),)),
        (simhash.Shingles(), ("a b c d e f", 5)),
        (fingerprint.fingerprint, ("some text of a document",)),
        (quality.features, ("Some text.",)),
        (toxicity.passages, ("so bad", toxicity.Scores(model.scores), model.other)),
        (decontaminate.leaks, ("alpha beta gamma delta epsilon zeta eta theta", found, 0.5, 160, 0.8, 0.5)),
        (substring_dedup.kept_words, ([b"a"], *substring_dedup.np.zeros((2, 0), int), 1)),
    ]
    path = tmp_path / "calls"
    path.write_bytes(cloudpickle.dumps([(f, a, repr(f(*a))) for f, a in calls]))
    code = "import pickle, sys\nfor f, a, want in pickle.load(open(sys.argv[1], 'rb')): assert repr(f(*a)) == want, f\nassert 'ranklume' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, str(path)], cwd="/", env=env, check=True, timeout=60)
