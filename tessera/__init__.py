"""tessera: knowledge-graph analytics as PySpark DataFrame plans.

The core (this package without ``tessera.llm``) holds the sources, functions, graph operators and
the engine facade.  ``tessera.llm`` holds the operators for training data; nothing else imports it.
"""

__version__ = "0.1.0"
