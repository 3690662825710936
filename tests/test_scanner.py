from fairlead.plans.scanner import scan


def test_scan(tmp_path):
    (tmp_path / "sample_data").mkdir()
    made = {"ok.py": "x = 1", "sample_data/a.dat": "1~2", "b.dat": "1~2", ".env.local": "", "k.txt": "-----BEGIN RSA " + "PRIVATE KEY-----", "h.md": "see /home/" + "someone/x", "t.md": "AKIA" + "ABCDEFGHIJKLMNOP"}
    for name, text in made.items():
        (tmp_path / name).write_text(text)
    found = dict(scan(tmp_path, [tmp_path / n for n in made]))
    assert found == {"b.dat": "blocked kind .dat", ".env.local": "environment file", "k.txt": "private key", "h.md": "home path", "t.md": "access key"}
