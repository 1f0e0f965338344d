"""Paint-colour and image analytics as Spark DataFrame operators.

Import the subpackages directly: ``functions`` (column expressions), ``sources``
(readers, writers and fixtures), ``operators`` (DataFrame to DataFrame), ``plans``
(styles and whole jobs) and ``streaming`` (render-request streams).
"""
