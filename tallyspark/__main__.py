"""python -m tallyspark STATEMENT.xml: performance of a statement's account."""

from __future__ import annotations

import sys
from argparse import ArgumentParser
from json import dumps


def main(arguments: list[str] | None = None) -> int:
    """0, or 2 where the statement or an argument can't be used."""
    parser = ArgumentParser(prog="python -m tallyspark", description="Sharpe ratio and other figures from the daily equity of an account statement in XML.")
    parser.add_argument("statement", help="path of the statement")
    parser.add_argument("--risk-free", metavar="RATE", default="auto", help="yearly rate as a fraction, or auto for the built-in one")
    parser.add_argument("--periods", type=int, default=252, metavar="N", help="periods in a year")
    parser.add_argument("--account", metavar="ID", help="which account, if there are several")
    parser.add_argument("--json", help="print JSON", action="store_true")
    args = parser.parse_args(arguments)

    from .errors import TallyError
    from .functions.rates import risk_free
    from .operators.summary import statement_performance
    from .session import session

    try:
        rate, origin = risk_free(args.risk_free)
        print(f"risk-free rate {100 * rate:.2f}%: {origin}", file=sys.stderr)
        found = statement_performance(session(), args.statement, account=args.account, risk_free_annual=rate, periods_per_year=args.periods)
    except (TallyError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(dumps(found.as_dict(), indent=2) if args.json else found.render())
    return 0


if __name__ == "__main__":
    sys.exit(main())
