"""worklens: analytics over tickets, change histories, sprints and documentation pages, as PySpark DataFrame operators."""
