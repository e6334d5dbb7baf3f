import hashlib
import random
import re

from pyspark.sql import functions as F

from tesselite.llm import queries, secrets

CODE = '''KEY_BASE = "abcDEF123456zz"
db = KEY_BASE
password = db
cfg["db_pwd"] = 'S3cr' + "et99x"
timeout: 30
"auth_token": "ya29.A0ARrdaM",
PASSWORD: hunter22secret
greeting = "hello world"
private_key = "${FROM_ENV}"
url = http://example.com/a=b
'''


def plain(text):
    """The base patterns, written once more and run without any short cut."""
    text = text or ""
    kinds = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    out = []
    for n, (kind, p) in enumerate(kinds.items()):
        for m in re.finditer(p, text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(2)
    pieces = ["token", "Secret", "API_KEY", "apikey", "passwd", "PASSWORD", "=", ":", " ", "'", '"', "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "\n", "K", "ſecret=abcdefg", "é", "toKen=abcdef", "x", ".", "_"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(14)))
        base, every = secrets.scan(text)
        assert base == plain(text) and set(base) <= set(every)


def test_assignments_constants_and_names():
    got = {(secrets.KINDS[k], CODE[a:b]) for a, k, b in secrets.scan(CODE)[1]}
    assert {("flow", "abcDEF123456zz"), ("pair", "S3cr"), ("pair", "et99x")} <= got
    assert not any("hello" in s or "30" == s or "FROM_ENV" in s for _, s in got)


def test_scores():
    assert secrets.sensitivity("dbPassword") == 1.0 and secrets.sensitivity("api.key") == 0.4 and secrets.sensitivity("signingKey") == 0.9 and secrets.sensitivity("monkey") == 0
    assert secrets.strength("changeme", True) == 0 and secrets.strength("aaaaaaaa", True) < 0.5 < secrets.strength("aB3$xY9!", True)


def test_redaction_keeps_names_and_clean_texts():
    assert secrets.redact('password = "hunter2xyz"') == 'password = "[SECRET]"'
    assert secrets.redact("nothing here") == "nothing here" and secrets.redact(None) is None and secrets.redact("") == ""


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, 'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d"', "x"), (3, 'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d"', "x"), (None, "z" * 200_000 + " secret:abcdef1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.find_secrets(df).select("doc_id", F.size("spans").alias("n"), "redacted").collect()
    assert sorted((r.doc_id or 0, r.n) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_secret_scan(spark, sf).collect():
        want = plain(texts[r.doc_id])
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_typed_assignments_and_phrases():
    secret = "Zx81kqPLm3v9"
    for line in ('api_key: str = "%s"', "const password: string = '%s';", 'val dbPassword: String? = "%s"', 'let auth_token: &\'static str = "%s";', 'var secret: Optional<String>="%s"', 'token: str | None = "%s"', 'pwd: Dict[str, List[str]] = "%s"', 'let creds: [String] = "%s"', 'token: "Optional[str]" = "%s"', 'private_key: std::string::String = "%s"', "password: SecretType = %s"):
        text = f"x = 1\n{line % secret}\ny = 2\n"
        at = text.index(secret)
        assert any(a <= at and at + len(secret) <= b and k in (0, 3) for a, k, b in secrets.scan(text)[1]), line
        assert secret not in secrets.redact(text), line
    # the type is no constant, constants keep their types' names apart, and encoded values are read as before
    text = 'greeting: str = "abcDEF123456zz"\npassword: str\nBASE: str = "qwertY123456"\npassword = BASE\n'
    assert {(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.scan(text)[1] if k > 2} == {("flow", "qwertY123456")}
    assert secrets.redact("pwd: aGVsbG8xMjM9PQ==") == "pwd: [SECRET]" and secrets.redact("pwd: ab12cd34ef=\n") == "pwd: [SECRET]\n"
    assert secrets.redact('passphrase = "four plain words here"') == 'passphrase = "[SECRET]"' and secrets.redact('db_password: str = "correct horse battery"') == 'db_password: str = "[SECRET]"'
    for text in ('greeting = "four plain words here"', 'password_hint = "four plain words here"', "passphrase = four plain words", 'token = "four plain words here"'):
        assert secrets.redact(text) == text
    secrets.scan("password:" + "<>" * 5000 + "|a[" * 5000)


SECRET = "Zx81kqPLm3v9"
HELD = [
    'auth        = "%s"',
    'password: str = "%s"',
    'let secret: &str = "%s"',
    'const apiKey: string = "%s"',
    'const dbPassword = new String("%s");',
    'String token = String.valueOf("%s");',
    'api_secret = b"%s"',
    "client_secret = r'%s'",
    "password = '''%s'''",
    'password = """%s"""',
    "<password>%s</password>",
    '<db:password type="plain"> %s </db:password>',
    "<key>authToken</key> <string>%s</string>",
    "mysql --host db --password %s --port 1",
    'deploy --api-key "%s"',
    "curl --token=%s x",
    "DB_PASSWORD=%s",
    "export AUTH_TOKEN=%s",
    '"client_secret": "%s",',
    "secret: %s",
    'conn.password => "%s"',
    'pwd := "%s"',
    "signing_key = `%s`",
    'os.environ["API_TOKEN"] = "%s"',
    "props.put = 1; access_key = '%s'",
    '@Value(password = "%s")',
    'auth_token : Optional[Dict[str, str]] = "%s"',
    'val bearerToken: Map<String, List<String>> = "%s"',
    'session_cookie = f"%s"',
    'encryption_key: "%s"',
]
CLEAN = [
    "timeout: 30",
    'name = "Zx81kqPLm3v9"',
    "<title>Zx81kqPLm3v9</title>",
    "<key>color</key> <string>Zx81kqPLm3v9</string>",
    "run --output Zx81kqPLm3v9",
    'keyboard = "Zx81kqPLm3v9"',
    'password = getenv("DB_PASSWORD")',
    'password = "changeme"',
    "password: ${DB_PASSWORD}",
    "auth: true",
    'password_hint = "the usual word"',
    "monkey: Zx81kqPLm3v9",
    'if key == "Zx81kqPLm3v9":',
    'author = "Zx81kqPLm3v9"',
    'tokenizer = "word-bpe-large"',
    'passenger: "Zx81kqPLm3v9"',
    'keynote = "Zx81kqPLm3v9"',
    'compass = "Zx81kqPLm3v9"',
    "https://example.com/a?page=Zx81kqPLm3v9",
    'secretary = "Zx81kqPLm3v9"',
]


def test_precision_and_recall_on_labelled_lines():
    found = [line for line in HELD if any(a <= (at := (line % SECRET).index(SECRET)) and at + len(SECRET) <= b for a, _, b in secrets.scan(line % SECRET)[1])]
    # the base patterns are as they are; what the lexer adds is right
    wrong = [line for line in CLEAN if any(k > 2 for _, k, _ in secrets.scan(line)[1])]
    assert set(HELD) - set(found) == set() and wrong == []
    for line in HELD:
        assert SECRET not in secrets.redact(line % SECRET), line


def test_lengths_do_not_matter():
    for blanks, name in ((200, "auth"), (5000, "my_password"), (1, "x" * 3000 + "_password"), (3, "a." * 4000 + "token")):
        text = f'first = 1\n{name}{" " * blanks}= "{SECRET}"'
        at = text.index(SECRET)
        assert any(a <= at and at + len(SECRET) <= b for a, _, b in secrets.scan(text)[1]), (blanks, name[:9])
    long = SECRET * 20_000
    assert secrets.redact(f'auth: List[{"int, " * 400}str] = "{long}"').count(SECRET) == 0
    # names that end alike but begin differently are different constants
    text = f'{"a" * 300}_base = "{SECRET}"\n{"b" * 300}_base = "nothing here"\npassword = {"b" * 300}_base\n'
    assert not any(k == 4 and text[a:b] == SECRET for a, k, b in secrets.scan(text)[1])


def test_odd_texts_take_linear_time():
    import time

    for text in ("password:" + "a:[" * 200_000, "key" + " " * 400_000 + "=", "<" * 200_000 + "password", "token" + '="""' * 50_000, "pwd " + "--" * 200_000, "secret" + "<a>" * 100_000, "key" + "x" * 400_000, "auth:" + "a|" * 100_000):
        began = time.perf_counter()
        secrets.scan(text)
        assert time.perf_counter() - began < 20, text[:20]
