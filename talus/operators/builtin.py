"""Built-in dimensions: allowed categories of packages, well-known names, known incidents, and users' own allowances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import graph

# Package and the category that is allowed in it.
ALLOWED = """
rustler system_exec
elixir_make system_exec
ex_doc system_exec
phoenix code_eval
phoenix_live_view code_eval
ecto code_eval
poison code_eval
credo code_eval
plug env_access
plug file_access
plug obfuscation
phoenix env_access
phoenix system_exec
phoenix obfuscation
credo system_exec
credo file_access
credo env_access
dialyxir system_exec
dialyxir env_access
dialyxir file_access
excoveralls system_exec
excoveralls env_access
file_system system_exec
file_system env_access
hex network_access
req network_access
finch network_access
mint network_access
typed_struct file_access
typed_struct system_exec
websock file_access
erlex file_access
phoenix dos_atom_exhaustion
ecto dos_atom_exhaustion
thousand_island network_access
phoenix_live_view obfuscation
phoenix_live_view compiler_hooks
phoenix_live_view file_access
phoenix_live_dashboard obfuscation
phoenix_live_reload file_access
phoenix_ecto code_eval
phoenix_template code_eval
phoenix_template compiler_hooks
phoenix_template file_access
postgrex network_access
postgrex env_access
myxql network_access
myxql env_access
db_connection obfuscation
ecto env_access
ecto_sql system_exec
ecto_sql file_access
telemetry_poller system_exec
telemetry_poller file_access
gettext code_eval
gettext compiler_hooks
gettext file_access
swoosh network_access
swoosh code_eval
bamboo network_access
gen_smtp network_access
esbuild system_exec
esbuild file_access
esbuild network_access
tailwind system_exec
tailwind file_access
tailwind network_access
dart_sass system_exec
dart_sass file_access
dart_sass network_access
dns_cluster network_access
plug_crypto obfuscation
castore file_access
bcrypt_elixir system_exec
argon2_elixir system_exec
pbkdf2_elixir code_eval
nimble_pool obfuscation
floki code_eval
floki file_access
mox code_eval
bypass network_access
"""
# Well-known package names; the first of equally near ones counts.
KNOWN_NAMES = """
phoenix ecto plug jason poison tesla req httpoison hackney
phoenix_html phoenix_live_view phoenix_live_dashboard phoenix_pubsub
phoenix_ecto telemetry telemetry_metrics telemetry_poller
swoosh bamboo oban broadway
absinthe absinthe_plug absinthe_phoenix absinthe_relay
ex_machina faker stream_data
credo dialyxir ex_doc
postgrex myxql ecto_sql
gettext mime plug_cowboy bandit cowboy cowlib ranch
nimble_csv nimble_parsec nimble_options nimble_pool nimble_totp
floki finch mint castore
guardian comeonin bcrypt_elixir argon2_elixir pbkdf2_elixir
timber logger_json
excoveralls mix_test_watch
rustler elixir_make
earmark earmark_parser makeup makeup_elixir
decimal uuid elixir_uuid
membrane_core nx explorer evision bumblebee
ash ash_postgres ash_phoenix ash_json_api ash_graphql ash_authentication
commanded eventstore
surface live_view_native
kino livebook
plug_crypto phoenix_swoosh phoenix_live_reload
ecto_dev_logger ecto_psql_extras ecto_enum
cors_plug plug_static_index_html
ex_aws ex_aws_s3 ex_aws_ses ex_aws_sqs ex_aws_sns ex_aws_ec2
stripity_stripe braintree_elixir
timex tzdata calendar
mox bypass hammox meck
ex_unit_notifier mix_test_interactive wallaby hound flaky_test_detector
sentry appsignal new_relic_agent
logger_file_backend logger_papertrail_backend
flow gen_stage
cachex con_cache nebulex
httpoison tesla_middleware_logger
grpc protobuf google_protos
bamboo_smtp bamboo_ses gen_smtp
pow coherence ueberauth ueberauth_google ueberauth_github
assent
yaml_elixir toml sweet_xml saxy
torch ex_admin kaffy backpex
libcluster horde swarm
dialyzex gradient type_check
waffle arc waffle_ecto
sobelow mix_audit
redix
mongodb_driver
commanded_ecto_projections commanded_eventstore_adapter
phoenix_slime phoenix_markdown slime
premailex
ex_cldr ex_cldr_numbers ex_cldr_dates_times ex_money
elixir_ls next_ls lexical
openai instructor
igniter spark reactor
open_api_spex
tailwind esbuild dart_sass
wallaby floki req_s3
quantum
briefly temp
nanoid hashids
fun_with_flags
"""
# The incident that ships with the corpus: name, operator, category.
INCIDENTS = (("phoenx", "any", "phantom_package"),)


def allowed(spark: SparkSession) -> DataFrame:
    """dep, category of the built-in allowances."""
    return spark.createDataFrame([tuple(x.split()) for x in ALLOWED.strip().split("\n")], "dep string, category string")


def known_names(spark: SparkSession) -> DataFrame:
    """name, place: each well-known name once, with its first place in the list."""
    return spark.createDataFrame(list(enumerate(dict.fromkeys(KNOWN_NAMES.split()))), "place int, name string").select("name", "place")


def incidents(spark: SparkSession) -> DataFrame:
    """name, op, low, high, categories, check_ids of the built-in incidents."""
    rows = [(name, op, None, None, [category], None) for name, op, category in INCIDENTS]
    return spark.createDataFrame(rows, "name string, op string, low string, high string, categories array<string>, check_ids array<string>")


def user_allowed(configs: DataFrame) -> DataFrame:
    """dep, category, reason of users' files (path, content): a list of pairs or triples, or a map with one under ``allow``.

    Comments are left out; a file that is neither gives no rows.
    """
    text = F.trim(F.regexp_replace("content", r'("(?:\\.|[^"\\])*")|#[^\n]*', "$1"), F.lit(" \t\r\n"))
    listed = F.when(text.startswith("["), text).when(text.rlike(r"^%\{\s*allow:\s*\["), text)
    entry = r'\{\s*:\w+\s*,\s*:\w+\s*(?:,\s*"(?:\\.|[^"\\])*"\s*)?\}'
    entries = configs.select(F.explode(F.regexp_extract_all(listed, F.lit(entry), F.lit(0))).alias("e"))
    part = lambda pattern: F.regexp_extract("e", pattern, 1)
    reason = F.when(F.col("e").contains('"'), part(r'(?s)"(.*)"')).otherwise("User allowlisted")
    return entries.select(part(r"^\{\s*:(\w+)").alias("dep"), part(r"^\{\s*:\w+\s*,\s*:(\w+)").alias("category"), reason.alias("reason"))


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("dep").agg(F.count("*").alias("n_findings"), F.array_sort(F.collect_set("category")).alias("categories"))


def transitive_notes(reached: DataFrame, found: DataFrame, allowances: DataFrame) -> DataFrame:
    """package, dep, n_findings, categories: what packages with an allowance reach that has findings.

    ``reached`` holds (package, dep) for each package and all it depends on, directly or not. Findings are
    counted before the join, so one package with very many of them is one row in it.
    """
    parents = allowances.select(F.col("dep").alias("package")).distinct()
    notes = reached.where("package <> dep").select("package", "dep").distinct().join(parents, "package", "left_semi")
    return notes.join(_counted(found), "dep").select("package", "dep", "n_findings", "categories")


def notes_along(edges: DataFrame, found: DataFrame, allowances: DataFrame) -> DataFrame:
    """As ``transitive_notes`` over all that the ``edges`` (src, dst) lead to: counts meet the classes of ``graph.reach``, whose pairs are made last and never stored."""
    roots, members = graph.reach(allowances.select(F.col("dep").alias("node")), edges)
    noted = members.join(_counted(found).withColumnRenamed("dep", "node"), "node")
    return graph.paired(roots, noted).select(F.col("root").alias("package"), F.col("node").alias("dep"), "n_findings", "categories")
