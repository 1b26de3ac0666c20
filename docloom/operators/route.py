"""Request validation, command routing and small guards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: The commands of the three bots.
RAG_COMMANDS = [
    "/exit", "/help", "/clear", "/save", "/add", "/kb_on", "/kb_off", "/kb_stats", "/kb_list", "/kb_clear", "/mode", "/topk", "/models",
    "/departments", "/prices", "/doctors", "/contacts", "/prepare",
]
ADVANCED_COMMANDS = ["/exit", "/clear", "/save", "/load", "/list", "/stats", "/mode", "/help"]
BASIC_COMMANDS = ["/exit", "/clear", "/save"]
COMMANDS = {"rag": RAG_COMMANDS, "advanced": ADVANCED_COMMANDS, "basic": BASIC_COMMANDS}
SUFFIXES = ("txt", "md", "py")


def validated(message: Column, missing: str = "message is missing", blank: str = "message is empty") -> tuple[Column, Column]:
    """(status, error): 400 for a missing or blank message, else 200 and null."""
    status = F.when(message.isNull() | (strip(message) == ""), F.lit(400)).otherwise(F.lit(200))
    return status, F.when(message.isNull(), F.lit(missing)).when(strip(message) == "", F.lit(blank))


def not_blank(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(strip(F.col(text)) != "")


def command_parts(text: Column) -> tuple[Column, Column]:
    """(command in lower case, argument or null) of a line that starts with `/`; else nulls."""
    parts, is_command = F.split(text, " ", 2), F.startswith(text, F.lit("/"))
    return F.when(is_command, F.lower(F.get(parts, F.lit(0)))), F.when(is_command, F.get(parts, F.lit(1)))


def route(command: Column, bot: str = "rag") -> Column:
    """The command if the bot has it, `unknown` if not, `message` for a line that isn't a command."""
    return F.when(command.isNull(), F.lit("message")).when(command.isin(COMMANDS[bot]), command).otherwise(F.lit("unknown"))


def canned_query(rows: DataFrame, canned: DataFrame, command: str) -> DataFrame:
    """Rows whose command has a fixed query, with that `query`. canned: (command, query), a short table."""
    return rows.join(canned.select(F.col("command").alias("_c"), "query"), F.col(command) == F.col("_c")).drop("_c")


def count_argument(arg: Column) -> Column:
    """The argument as a number if it is digits alone, else null."""
    return F.when(arg.rlike("^[0-9]{1,18}$"), arg).try_cast("long")


def load_path(arg: Column, folder: str = "conversations") -> Column:
    """A file name with `.json` and the folder in front, where they are missing."""
    name = F.when(F.endswith(arg, F.lit(".json")), arg).otherwise(F.concat(arg, F.lit(".json")))
    return F.when(F.startswith(name, F.lit(folder + "/")), name).otherwise(F.concat(F.lit(folder + "/"), name))


def has_suffix(path: Column, suffixes=SUFFIXES) -> Column:
    return path.rlike(r"\.(" + "|".join(suffixes) + ")$")
