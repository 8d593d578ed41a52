"""A corpus of source files derived from ``orders``: one small file per order.

Every file is a pure function of its row: fixed snippets are chosen by arithmetic on the keys,
so the corpus has as many files as the table has rows, needs no shuffle, and the same text can be
built in SQL for result checks. Credentials are fabricated from hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.session import dealt
from auditspark.sources.derived import table

# {K} is the order key, {C} the customer key, {H} a hash of the order key, {D} a dash
SLOTS: list[tuple[int, int, list[str]]] = [
    # (factor of the order key, factor of the customer key, choices)
    (1, 0, [
        "from langchain.agents import AgentExecutor\nimport openai",
        "import anthropic\nimport logging",
        "from crewai import Crew, Agent",
        "import json\nimport os",
        "from mcp.server.fastmcp import FastMCP\nserver_{K} = FastMCP('m{K}')",
        "from pydantic_ai import Chat\nimport stripe",
        "import litellm\nimport psycopg2",
        "import os\nimport requests",
        "from openai import OpenAI\nfrom slack_sdk import WebClient",
        "import math",
        "from smolagents import CodeAgent\nimport boto3",
    ]),
    (1, 1, [
        "token = 'ghp_{H}'",
        "API = 'sk{D}{H}'  # live",
        "# old key sk{D}{H}",
        "key = 'sk{D}xxxxxxxxxxxxxxxxxxxxxxxx'",
        "password = 'Tr0ub4dor{K}'",
        "password = os.environ['DB_PASSWORD']",
        "db_password = 'password'",
        "pwd: '${{SECRET}}'",
        "pair = ['ghp_{H}', 'gsk_{H}']",
        "limit = {K}",
        "token = 'ghp_{H}'  # auditspark: ignore[SEC001] rotated",
        "# auditspark: ignore[SEC001, NOPE1, SEC002]\ntoken = 'ghp_{H}'",
        "name = 'plain {C}'",
    ]),
    (3, 1, [
        "q = f\"SELECT id FROM t{C} WHERE n = {{x}}\"",
        "q = \"DELETE FROM t{C} WHERE id = %s\" % (x,)",
        "q = 'INSERT INTO log VALUES ({{}})'.format(x)",
        "q = 'DROP TABLE t{C} ' + name",
        "q = 'SELECT a FROM b WHERE c = ?'",
        "row = store[{K}]",
        "# q = f\"SELECT id FROM t{C} WHERE n = {{x}}\"",
    ]),
    (1, 5, [
        "URL = 'http://api.shop{C}.com/v1'",
        "URL = 'http://localhost:8080/v1'",
        "URL = 'https://api.stripe.com/v1/charges'",
        "a, b = 'http://x.test/a', 'http://pay{C}.net/b'",
        "URL = 'https://hooks.slack.com/services/{C}'",
        "HOST = 'db{C}.internal'",
    ]),
    (7, 3, [
        "def pull_{K}(u):\n    return requests.get(u)",
        "def pull_{K}(u):\n    return requests.get(\n        u,\n        headers={{}},\n        timeout=3,\n    )",
        "def pull_{K}(u):\n    return httpx.post(u, json={{'k': {C}}})",
        "def calm_{K}(u):\n    return u",
        "def pull_{K}(u):\n    r = requests.get(\n        u,\n        a=1,\n        b=2,\n        c=3,\n        d=4,\n        e=5,\n        f=6,\n        g=7,\n        timeout=9)\n    return r",
    ]),
    (5, 7, [
        "def guard_{K}(x):\n    try:\n        x.go()\n    except ValueError:\n        pass",
        "def guard_{K}(x):\n    try:\n        x.go()\n    except ValueError:\n        log.error('bad')",
        "def guard_{K}(x):\n    try:\n        x.go()\n    except Exception:  # ignore\n        pass\n    return x",
        "def plain_{K}(x):\n    return x",
    ]),
    (11, 1, [
        "def act_{K}(client, prompt):\n    out = client.chat.completions.create(model='gpt-4o', messages=[prompt])\n    text = out.choices[0].message.content\n    return eval(text)",
        "def act_{K}(client, cursor):\n    reply = agent.run('go')\n    sql = reply.strip()\n    cursor.execute(sql)",
        "def act_{K}(request, client):\n    q = request.args['q']\n    prompt = f\"system: {{q}}\"\n    return client.chat.completions.create(messages=[prompt])",
        "def act_{K}(user, client):\n    mail = user.email\n    note = 'hi ' + mail\n    requests.post('https://crm{C}.net/in', json=note)\n    return client.responses.create(input=note)",
        "def run_{K}(cmd):\n    os.system(cmd)\n\ndef act_{K}(llm):\n    plan = llm.invoke('x')\n    run_{K}(plan)",
        "def act_{K}(items, client):\n    for item in items:\n        r = client.responses.create(input=item)\n        subprocess.run(item)\n    return r",
        "def act_{K}(items, client):\n    for item in items:\n        time.sleep(1)\n        r = client.messages.create(input=item)\n        subprocess.run(item)\n    return r",
        "def act_{K}(x):\n    y = x + 1\n    return y",
        "def act_{K}(x:\n    broken(",
        "def act_{K}(v):\n    if v > MAX_AMOUNT:\n        return None\n    return stripe.Refund.create(v)",
    ]),
    (13, 5, [
        "refund_agent = AgentExecutor(tools=[t])",
        "helper = Agent(role='h')\nplanner = Agent(role='p')",
        "class BillingAgent:\n    tools = [a, b]",
        "class UserAgent:\n    name = 'x'",
        "def build_sales_agent(x):\n    return x",
        "ops_agent = make(x)\nops_agent.run('go')",
        "value = compute({K})",
        "crew = Crew(agents=[a])\ncrew.kickoff()",
    ]),
    (17, 11, [
        "@tool\ndef pay_{K}(v):\n    stripe.Refund.create(v)",
        "@tool\ndef send_{K}(m):\n    send_email(m)\n    print(m)",
        "tools = [lookup]\nlogger.info('ready')",
        "def ok_{K}(v):\n    require_auth(v)\n    return v",
        "approved = confirm_order({K})",
        "stripe.Transfer.create(amount={C})",
        "x = shutil.rmtree('/tmp/x{K}')",
        "idx = pinecone.Index('i{C}')",
        "total = {C} + 1",
    ]),
    (19, 13, [
        "m = AutoModel.from_pretrained('org/m{C}')",
        "m = AutoModel.from_pretrained('org/m{C}', revision='abc')",
        "m = pipeline('x', model='org/m{C}', trust_remote_code=True)",
        "cfg = dict(model='gpt-4o', temperature=0.1)",
        "cfg = dict(model='gpt-4o-2024-08-06')",
        "cfg = dict(model='claude-3-5-haiku-latest', n={C})",
        "c = Client(base_url='http://llm{C}.corp.net/v1')",
        "c = Client(base_url='http://localhost:11434/v1')",
        "w = torch.load('w{C}.bin')\nf = hf_hub_download('org/m')",
        "cfg = dict(size={C})",
    ]),
]

DIRS = ["src", "app", "tests", "lib/core", "vendor", "svc/api"]
EXTENSIONS = ["py", "py", "py", "py", "ts", "py", "txt", "py"]


def choice_count() -> list[int]:
    return [len(c) for _, _, c in SLOTS]


def unescaped(text: str) -> str:
    return text.replace("{{", "{").replace("}}", "}")


def _filled(template: str, k: Column, c: Column, h: Column) -> Column:
    """The snippet with its holes filled, as one concat of literals and columns."""
    holes = {"{K}": k, "{C}": c, "{H}": h, "{D}": F.lit("-")}
    parts, rest = [], template
    while rest:
        at = {hole: rest.find(hole) for hole in holes if hole in rest}
        if not at:
            parts.append(F.lit(unescaped(rest)))
            break
        hole = min(at, key=at.get)
        if at[hole]:
            parts.append(F.lit(unescaped(rest[:at[hole]])))
        parts.append(holes[hole])
        rest = rest[at[hole] + len(hole):]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length, content): everything, before listing rules."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    k, c = key.cast("string"), cust.cast("string")
    h = F.substring(F.sha2(k, 256), 1, 36)
    pieces = []
    for a, b, choices in SLOTS:
        index = (key * a + cust * b) % len(choices)
        expr = None
        for i, template in enumerate(choices):
            filled = _filled(template, k, c, h)
            expr = F.when(index == i, filled) if expr is None else expr.when(index == i, filled)
        pieces.append(expr)
    where = F.lit(DIRS[-1])
    for i, d in enumerate(DIRS[:-1]):
        where = F.when(cust % len(DIRS) == i, d).otherwise(where)
    ext = F.lit(EXTENSIONS[-1])
    for i, e in enumerate(EXTENSIONS[:-1]):
        ext = F.when(key % len(EXTENSIONS) == i, e).otherwise(ext)
    files = o.select(
        F.concat(where, F.lit("/m"), cust % 20, F.lit("/f"), k, F.lit("."), ext).alias("path"),
        F.concat_ws("\n", *pieces).alias("content"))
    return files.select("path", F.octet_length("content").cast("long").alias("length"), "content")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed corpus with languages and test paths."""
    from auditspark.sources.corpus import listed

    return listed(raw_files(spark, sf_dir))[0]
